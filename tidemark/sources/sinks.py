"""Writers: triples, named graphs, slices, exports, registries, retry lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ntriples_lines(triples: DataFrame) -> DataFrame:
    escaped = F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(""))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"))), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)


def append_graph(triples: DataFrame, store: str) -> None:
    """Adds triples to their named graphs (column g)."""
    triples.write.mode("append").partitionBy("g").parquet(store)


def replace_graphs(triples: DataFrame, store: str) -> None:
    """Replaces the named graphs that ``triples`` has rows of, and no other; the old files go when the new ones are committed."""
    triples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("g").parquet(store)


def clear_graph(spark: SparkSession, store: str, graph: str | None = None) -> None:
    """Removes one named graph, or all."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store if graph is None else f"{store}/g={graph}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def promote(df: DataFrame, staging: str, target: str, check: Callable[[DataFrame], bool]) -> bool:
    """Writes to ``staging``, reads that back, and moves it to ``target`` only if ``check`` holds."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    if not check(spark.read.parquet(staging)):
        return False
    jvm = spark._jvm
    source, final = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    # The old table stays beside the new one until that is in place, and comes back if it is not.
    old = jvm.org.apache.hadoop.fs.Path(target.rstrip("/") + ".old")
    files.delete(old, True)
    if files.exists(final) and not files.rename(final, old):
        return False
    if not files.rename(source, final):
        if files.exists(old):
            files.rename(old, final)
        return False
    files.delete(old, True)
    return True


@dataclass
class Slice:
    """One export: its columns, which of them must not be null, a text that a column must contain, and casts."""

    name: str
    columns: list[str]
    required: list[str] = field(default_factory=list)
    how: str = "any"
    contains: tuple[str, str] | None = None
    only_if_missing: str | None = None
    casts: dict[str, str] = field(default_factory=dict)


def slice_rows(df: DataFrame, spec: Slice) -> DataFrame:
    """The rows and columns of a slice; columns that are not there are left out."""
    out = df
    if spec.contains:
        out = out.filter(F.contains(F.lower(spec.contains[0]), F.lower(F.lit(spec.contains[1]))))
    if spec.only_if_missing:
        out = out.filter(F.col(spec.only_if_missing).isNull())
    out = out.select(*[F.col(c).try_cast(spec.casts[c]).alias(c) if c in spec.casts else F.col(c) for c in spec.columns if c in df.columns])
    return out.na.drop(how=spec.how, subset=[c for c in spec.required if c in out.columns]) if spec.required else out


def export_slices(df: DataFrame, specs: list[Slice], folder: str) -> None:
    for spec in specs:
        slice_rows(df, spec).write.mode("overwrite").csv(f"{folder}/{spec.name}", header=True)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True)


def save_registry(registry: DataFrame, path: str) -> None:
    """Clusters as JSON lines: canonical and sorted members."""
    registry.groupBy("canonical").agg(F.array_sort(F.collect_set("member")).alias("members")).write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("canonical string, members array<string>").json(path).select("canonical", F.explode("members").alias("member"))


def registry_triples(aliases: DataFrame, graph: str) -> DataFrame:
    """Preferred (the first) and other labels of a registry (id, alias, pos)."""
    predicate = F.when(F.col("pos") == 0, "skos:prefLabel").otherwise("skos:altLabel")
    null = F.lit(None).cast("string")
    return aliases.select(F.lit(graph).alias("g"), F.col("id").alias("s"), predicate.alias("p"), F.col("alias").alias("o"), F.lit("literal").alias("o_kind"), F.lit("xsd:string").alias("o_dt"), null.alias("o_lang"))


def needs_rerun(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (path) without a row in ``parsed``."""
    return files.join(parsed.select("path").distinct(), "path", "left_anti")
