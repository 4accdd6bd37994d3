"""Operators that depend on row order: fills, row numbers, keep-first, duplicate flags, gap clusters, sessions.

Every one takes the columns that part the rows (``within``: a file, a user) and the one that orders them, so that work
is spread over parts and never needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(within: list[str], order: list[str]):
    return Window.partitionBy(*within).orderBy(*order)


def forward_fill(df: DataFrame, columns: list[str], within: list[str], order: list[str]) -> DataFrame:
    """Nulls take the last value before them in their part; leading nulls stay."""
    w = _ordered(within, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def hierarchical_fill(df: DataFrame, levels: list[str], within: list[str], order: list[str]) -> DataFrame:
    """Forward fill of nested levels, the widest first: a new value of a level empties those below it."""
    out, groups = df, []
    w = _ordered(within, order).rowsBetween(Window.unboundedPreceding, 0)
    for i, level in enumerate(levels):
        inner = Window.partitionBy(*within, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_filled_{i}", F.last(level, ignorenulls=True).over(inner))
        out = out.withColumn(f"_run_{i}", F.count(level).over(inner if groups else w))
        groups.append(f"_run_{i}")
    filled = out.withColumns({level: F.col(f"_filled_{i}") for i, level in enumerate(levels)})
    return filled.select(*df.columns)


def row_index(df: DataFrame, within: list[str], order: list[str], name: str = "row", first: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(_ordered(within, order)) + (first - 1))


def keep_first(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row, in order, for each combination of ``subset``."""
    return df.withColumn("_place", F.row_number().over(_ordered(subset, order))).filter("_place = 1").drop("_place")


def duplicate_flag(df: DataFrame, subset: list[str], name: str = "duplicated") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*subset)) > 1)


def gap_clusters(df: DataFrame, value: str, tolerance: float, within: list[str], order: list[str], name: str = "cluster") -> DataFrame:
    """Numbers runs of rows whose ``value`` is at most ``tolerance`` from the one before: boxes to lines, clicks to sessions."""
    w = _ordered(within, order)
    far = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    return df.withColumn("_far", F.coalesce(far, F.lit(0))).withColumn(name, F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def best_of(df: DataFrame, within: list[str], score: str, order: list[str]) -> DataFrame:
    """The row with the highest score of each part; ties by ``order``."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(score), *order))).filter("_place = 1").drop("_place")
