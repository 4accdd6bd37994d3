"""Constraint checks. Each returns its violations: focus, check, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violations(rows: DataFrame, key: str, check: str, value: Column) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("focus"), F.lit(check).alias("check"), value.cast("string").alias("value"))


def check_datatype(df: DataFrame, key: str, column: str, datatype: str) -> DataFrame:
    """Texts that are no value of the type."""
    return _violations(df.filter(F.col(column).isNotNull() & F.col(column).try_cast(datatype).isNull()), key, f"datatype:{column}", F.col(column))


def check_class(df: DataFrame, key: str, column: str, members: DataFrame) -> DataFrame:
    """Values that are not among the members (first column) of a class."""
    return _violations(df.filter(F.col(column).isNotNull()).join(members.select(F.col(members.columns[0]).alias(column)), column, "left_anti"), key, f"class:{column}", F.col(column))


def check_count(nodes: DataFrame, key: str, links: DataFrame, link_key: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Nodes with too few or too many links; nodes without any count as zero."""
    counted = nodes.select(key).distinct().join(links.groupBy(F.col(link_key).alias(key)).agg(F.count(F.lit(1)).alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _violations(counted.filter((F.col("n") < least) | (F.col("n") > most if most is not None else F.lit(False))), key, "count", F.col("n"))


def check_in(df: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    return _violations(df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)), key, f"in:{column}", F.col(column))


def check_pattern(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    return _violations(df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(pattern)), key, f"pattern:{column}", F.col(column))


def check_less_or_equal(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    return _violations(df.filter(F.col(low) > F.col(high)), key, f"order:{low}:{high}", F.col(low))


def check_node_kind(triples: DataFrame, predicate: str, kind: str) -> DataFrame:
    """Values of a predicate that are no node of the kind (iri, blank or literal)."""
    return _violations(triples.filter((F.col("p") == predicate) & (F.col("o_kind") != kind)), "s", f"kind:{predicate}", F.col("o"))


def check_has_value(nodes: DataFrame, key: str, links: DataFrame, link_key: str, value: str, wanted: str) -> DataFrame:
    """Nodes that have no link to a wanted value."""
    having = links.filter(F.col(value) == wanted).select(F.col(link_key).alias(key))
    return _violations(nodes.select(key).distinct().join(having, key, "left_anti"), key, f"value:{wanted}", F.lit(None))


# Of each level of places its code and the levels of what it is part of.
PLACE_SHAPES = {
    "Reg": (r"^[0-9]{2}00000000$", ["Island Group"]),
    "Prov": (r"^[0-9]{5}00000$", ["Reg"]),
    "City": (r"^[0-9]{7}000$", ["Prov", "Reg"]),
    "Mun": (r"^[0-9]{7}000$", ["Prov", "Reg"]),
    "SubMun": (r"^[0-9]{10}$", ["City", "Mun", "Prov"]),
    "Bgy": (r"^[0-9]{10}$", ["City", "Mun", "SubMun"]),
}


def check_places(places: DataFrame) -> DataFrame:
    """Places (code, level, parent) whose code is none of their level, or whose parent is missing, unknown or of a wrong level."""
    pattern, above = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for level, (code, parents) in PLACE_SHAPES.items():
        pattern, above = F.when(F.col("level") == level, F.lit(code)).otherwise(pattern), F.when(F.col("level") == level, F.array(*map(F.lit, parents))).otherwise(above)
    known = places.select(F.col("code").alias("parent"), F.col("level").alias("_above"))
    marked = places.select("code", "level", "parent").join(known, "parent", "left").withColumns({"_pattern": pattern, "_wanted": above})
    bad_level = _violations(marked.filter("_pattern IS NULL AND level NOT IN ('Country', 'Island Group')"), "code", "level", F.col("level"))
    bad_code = _violations(marked.filter(~F.expr("code RLIKE _pattern")), "code", "code", F.col("level"))
    bad_parent = _violations(marked.filter(F.col("_wanted").isNotNull() & ~F.coalesce(F.array_contains("_wanted", F.col("_above")), F.lit(False))), "code", "parent", F.col("parent"))
    return bad_level.unionByName(bad_code).unionByName(bad_parent)


def focus_nodes(triples: DataFrame, target: str, base: str, once: bool = False) -> DataFrame:
    """The nodes of a class that a batch types itself: those that shapes are held against. ``once``: no triple comes twice, so no node does."""
    found = triples.filter((F.col("p") == "rdf:type") & (F.col("o") == target) & F.col("s").startswith(base)).select(F.col("s").alias("focus"))
    return found if once else found.distinct()


def check_detail(nodes: DataFrame, key: str, details: DataFrame, detail_key: str) -> DataFrame:
    """Nodes that say nothing beyond where they are."""
    return _violations(nodes.join(details.select(F.col(detail_key).alias(key)), key, "left_anti"), key, "detail", F.lit(None))


def conforming(rows: DataFrame, key: str, violations: DataFrame) -> DataFrame:
    """The rows whose key no violation names."""
    return rows.join(violations.select(F.col("focus").alias("_focus")).distinct(), F.col(key).cast("string") == F.col("_focus"), "left_anti")


def gate(batches: DataFrame, batch: str, key: str, violations: DataFrame, write: Callable[[DataFrame], None], fail_fast: bool = False) -> list[str]:
    """Writes the rows of batches without any violation; returns the other batches' names (a bounded number of batches)."""
    bad = batches.join(violations.select(F.col("focus").alias("_focus")).distinct(), F.col(key).cast("string") == F.col("_focus"), "left_semi").select(batch).distinct()
    names = sorted(str(r[0]) for r in bad.collect())
    if names and fail_fast:
        raise ValueError(f"batches that do not conform: {names}")
    write(batches.join(bad, batch, "left_anti"))
    return names
