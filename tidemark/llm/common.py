"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named Parquet table, read through Spark so that any supported store works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder. For rows with texts, which checkpoints do not compress."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``; null ids count as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % F.lit(modulus)


#: Copies of a row that come from one array.
RUN = 4096


def copied(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says (null: once), in runs, so that no array is long."""
    n = F.coalesce(copies, F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    runs = rows.withColumn("_run", F.explode(F.sequence(zero, F.floor((n - 1) / RUN))))
    return runs.withColumn("_copy", F.explode(F.sequence(zero, F.least(F.lit(RUN).cast("long"), n - F.col("_run") * RUN) - 1))).drop("_run", "_copy")


def beside(docs: DataFrame, keep: tuple[str, ...]) -> tuple[list[Column], str]:
    """Columns to carry through an Arrow function under names that clash with none, and their schema (with a leading comma)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return [docs[c].alias(f"carried_{i}") for i, c in enumerate(keep)], "".join(f", carried_{i} {kinds[c]}" for i, c in enumerate(keep))


def renamed(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``df`` with the carried columns under their own names again."""
    return df.select(*[c for c in df.columns if not c.startswith("carried_")], *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(keep)])


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column as one byte buffer, n + 1 offsets and a null mask; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return raw[base : int(offsets[-1])], offsets - base, nulls


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` or fewer; one longer text is a batch of its own."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        if array.nbytes <= most:
            if len(batch):
                yield batch
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0)).astype(np.int64)
        begin, total = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)
