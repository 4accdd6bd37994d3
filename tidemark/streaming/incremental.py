"""Streaming variants: calendar counts over late events, and linking of newly arrived events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.resolve import blocked_pairs, new_pairs


def calendar_counts(events: DataFrame, time: str, late: str = "7 days", span: str = "1 day") -> DataFrame:
    """Events by ``span`` of a streaming (or batch) frame; streams wait ``late`` for late events and then forget a span."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a time zone
    marked = stamped.withWatermark(time, late) if events.isStreaming else stamped
    return marked.groupBy(F.window(time, span).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("period"), "events")


def link_arrivals(arrivals: DataFrame, all_events: str, pairs: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch: adds its events to ``all_events`` and the new candidate pairs to ``pairs`` (Parquet folders).

    A batch that is run again writes the same pairs once more, and readers drop repeated pairs.
    """

    def judge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("append").parquet(all_events)
        known = spark.read.parquet(all_events).dropDuplicates(["event"])
        found = blocked_pairs(known, fresh=batch.dropDuplicates(["event"]))  # no pair of old events is looked at again
        try:
            found = new_pairs(found, spark.read.parquet(pairs))
        except Exception as missing:  # the first batch finds no pairs yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        found.write.mode("append").parquet(pairs)

    return arrivals.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
