"""tidemark: disaster knowledge-graph analytics expressed as lazy Spark plans."""
