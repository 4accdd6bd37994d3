"""A corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``. Rows without a doc_id are judged by their text; among near duplicates they come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, toxicity
from tidemark.llm.common import table, written
from tidemark.llm.near_dedup import first_rows
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_file, tokenizer_pattern
from tidemark.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BESIDE_ID = ("text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below its threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), lambda doc_id: ~toxicity.held_out(doc_id))
    return toxicity.score_toxicity(docs, model, BESIDE_ID).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: some letter, and not far beyond all centroids."""
    model = language_id.fit(docs, lambda doc_id: ~language_id.held_out(doc_id))
    return language_id.identify(docs, model, BESIDE_ID).filter(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id, null last; of rows that repeat it, the least hash of all columns."""
    # Numbers of rows are written down, since they may change when rows are made again.
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row"), F.xxhash64(*COLUMNS).alias("digest")))
    return rows.join(first_rows(rows, "row", "digest"), "row", "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that start in an earlier one; code points cut in two go as well."""
    left = remove_repeats(docs, ("lang", "source"), whole_characters=True)
    text = F.col("remaining").cast("string")
    return left.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: The stages are trained models, fingerprints and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
