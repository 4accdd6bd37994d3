"""Changes of shape: unpivot, exploding lists, full outer merges, column moves, all-null rows, renames by tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_amounts(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each amount that is neither null nor zero."""
    return df.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull() & (F.col(value) != 0))


def explode_list(df: DataFrame, column: str, separator: str, name: str, ordinal: str | None = None) -> DataFrame:
    """One row for each trimmed non-empty part of a list; ordinals count from 1 over all parts."""
    parts = df.select("*", F.posexplode(F.split(column, separator)).alias("_pos", "_part")).withColumn(name, F.trim("_part")).filter(F.col(name) != "")
    return (parts.withColumn(ordinal, F.col("_pos") + 1) if ordinal else parts).drop("_pos", "_part")


def bracketed_incidents(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``[type: place]; [type: place]`` with ordinal, incident_type and incident_place."""
    out = explode_list(df, column, ";", "_one", "ordinal")
    pattern = r"\[?\s*([^:\]]+)(?::\s*([^\]]*))?\]?"
    return out.withColumns({"incident_type": F.trim(F.regexp_extract("_one", pattern, 1)), "incident_place": F.nullif(F.trim(F.regexp_extract("_one", pattern, 2)), F.lit(""))}).drop("_one")


def long_counts(df: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """Wide counts (column: kind) as rows of kind, cnt and an ordinal that skips the kinds without a count."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("cnt")) for c, k in kinds.items()]), lambda e: e["cnt"].isNotNull())
    return df.select(*keys, F.posexplode(entries).alias("_pos", "e")).select(*keys, (F.col("_pos") + 1).alias("ordinal"), "e.kind", "e.cnt")


def full_merge(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of all frames on one key; a column that an earlier frame has is not taken again."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "full")

    return reduce(merge, frames)


def move_values(df: DataFrame, source: str, target: str, move: Column) -> DataFrame:
    """Moves the values of ``source`` to ``target`` where ``move`` holds; both are worked out from the old columns."""
    moved = {target: F.when(move, F.col(source)).otherwise(F.col(target)), source: F.when(move, None).otherwise(F.col(source))}
    return df.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in df.columns])


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="all", subset=columns)


def drop_words(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose cell is none of the words, in any case; null cells go as well."""
    return df.filter(~F.lower(column).isin(*[w.lower() for w in words]))


def collapse(df: DataFrame, value: str, key: str) -> DataFrame:
    """Drops summary rows: those with a key but no value."""
    return df.filter(~(F.col(value).isNull() & F.col(key).isNotNull()))


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*["_".join(c.lower().split()) for c in df.columns])


def rename_by_tokens(df: DataFrame, groups: dict[str, list[list[str]]]) -> DataFrame:
    """Renames each column to the first name, not used yet, of which some group of tokens is all in the column's name."""
    used: set[str] = set()
    names = []
    for column in df.columns:
        name = next((n for n, options in groups.items() if n not in used and any(all(t in column.lower() for t in tokens) for tokens in options)), column)
        used.add(name)
        names.append(name)
    return df.toDF(*names)


def split_cells(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Splits a cell of several numbers into the named columns; missing ones are null."""
    parts = F.split(F.trim(F.col(column)), r"\s+", len(names) + 1)
    return df.withColumns({n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(names)})


def entities(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of an entity (name: type) out of text cells: the text ``none`` is null, bad values are null, rows without any value go."""
    cell = lambda c: F.when(F.lower(F.trim(F.col(c))) == "none", None).otherwise(F.col(c))
    out = df.select(*[(cell(n) if n in df.columns else F.lit(None).cast("string")).try_cast(t).alias(n) for n, t in fields.items()])
    return drop_empty_rows(out)


def duplicate_report(df: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The most frequent repeated combinations of ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), *keys).limit(most)


def split_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose cells hold several values, two or more spaces apart, as one row for each; the other columns repeat."""
    parts = F.arrays_zip(*[F.split(F.trim(F.col(c)), r"\s{2,}").alias(c) for c in columns])
    out = df.select(*[c for c in df.columns if c not in columns], F.explode_outer(parts).alias("_p"))
    return out.select(*[F.col(f"_p.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


# Names of regions that do not have the word in them.
REGION_NAMES = ["mimaropa", "calabarzon", "ncr", "car", "barmm", "armm", "caraga", "soccsksargen", "nir"]


def move_invalid_regions(df: DataFrame, region: str = "region", target: str = "municipality") -> DataFrame:
    """Texts in the region column that name no region belong to the other column."""
    low = F.lower(region)
    return move_values(df, region, target, ~low.isin(*REGION_NAMES) & ~F.contains(low, F.lit("region")))


def null_counts(df: DataFrame, column: str) -> DataFrame:
    """Cells that hold a bare number, such as a count of villages where their names should be, become null."""
    return df.withColumn(column, F.when(F.trim(F.col(column).cast("string")).rlike(r"^\d+$"), None).otherwise(F.col(column)))


def without_breakdowns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that say ``breakdown`` become null."""
    return df.withColumns({c: F.when(F.col(c).rlike("breakdown"), None).otherwise(F.col(c)) for c in columns if c in df.columns})


def quantity_headers(df: DataFrame) -> DataFrame:
    """A header with ``region_`` in it is a quantity; ``barangay`` names the village."""
    return df.withColumnsRenamed({c: "qty" for c in df.columns if "region_" in c} | {"barangay": "hasBarangay"})
