"""Readers of report folders: text tables, JSON sidecars, N-Triples, file discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import TRIPLES


def read_cells(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """A CSV table as texts, with the file and the row number in it, so that the order of rows is not lost.

    Files are read whole by one task each, since quoted cells may span lines; a quote within one is doubled. ``strict``
    fails on broken rows, otherwise they become nulls.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', mode="FAILFAST" if strict else "PERMISSIVE")
    df = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    from tidemark.operators.sequence import row_index

    return row_index(df, ["file"], ["_id"], "row").drop("_id")


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects of one file each, with the event folder they lie in."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"))


def discover(spark: SparkSession, root: str, keywords: dict[str, str]) -> DataFrame:
    """Files below ``root`` by kind (the first keyword in the name): path, folder, kind, modified. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"))
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    kind = F.coalesce(*[F.when(F.contains(name, F.lit(word.lower())), F.lit(k)) for k, word in keywords.items()])
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), kind.alias("kind"), "modified").filter("kind IS NOT NULL")


def latest(files: DataFrame) -> DataFrame:
    """The newest file of each kind; ties by path."""
    return files.groupBy("kind").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of names to aliases as rows: id, alias, pos."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("id", "aliases")).select("id", F.posexplode("aliases").alias("pos", "alias"))


def read_ntriples(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """N-Triples lines as the triple table; comments, empty and malformed lines are left out."""
    term = r'<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?'
    line = rf"^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:{term})\s*\.\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    raw = spark.read.text(path).filter(F.col("value").rlike(line))
    some = lambda c: F.nullif(c, F.lit(""))
    literal = F.replace(F.replace(F.replace(part(6), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    kind = F.when(part(4) != "", "iri").when(part(5) != "", "blank").otherwise("literal")
    return raw.select(
        F.lit(graph).alias("g"), F.coalesce(some(part(1)), part(2)).alias("s"), part(3).alias("p"), F.when(kind == "iri", part(4)).when(kind == "blank", part(5)).otherwise(literal).alias("o"),
        kind.alias("o_kind"), some(part(8)).alias("o_dt"), some(part(7)).alias("o_lang"),
    ).to(spark.createDataFrame([], TRIPLES).schema)


def new_entries(listing: DataFrame, manifest: DataFrame, key: str = "download_url", time: str = "posted_at") -> DataFrame:
    """Entries of a listing that a manifest of earlier runs does not have and that are not older than its newest one."""
    newest = manifest.agg(F.max(time).alias("_newest"))
    fresh = listing.join(manifest.select(key), key, "left_anti").crossJoin(F.broadcast(newest))  # one row
    return fresh.filter(F.col("_newest").isNull() | (F.col(time) >= F.col("_newest"))).drop("_newest")
