"""Spark sessions and the settings that the plans rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Where it is unset a local session gets a temporary folder, removed when Python ends; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, with its lineage cut; survives lost executors. For slim rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read again, so that Spark knows its size and can push filters into it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder. For rows with texts, which checkpoints do not compress."""
    return stored(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet")
