"""Rule classification of free text, routing of ambiguous answers, warnings, and longest-alias labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rules import GROUPS, RULES

#: Triggers, label, and words of which one must be there as well (none: always).
Rule = tuple[list[str], str, list[str]]

def rule_labels(text: Column, rules: list[Rule] = RULES) -> Column:
    """All labels whose rule fires, in the order of the rules, each once."""
    low = F.lower(text)
    has = lambda words: low.rlike("|".join("\\Q" + w.lower() + "\\E" for w in words))
    fired = [F.when(has(triggers) & (has(context) if context else F.lit(True)), F.lit(label)) for triggers, label, context in rules]
    return F.array_distinct(F.array_compact(F.array(*fired)))


def routed(labels: Column, groups: list[set[str]] = GROUPS) -> Column:
    """Struct of the label that the rules settle and the candidates for a model otherwise.

    One label, or a first label in no group of alike ones, is settled; several alike ones are left to a model with the
    union of their groups as candidates; no label leaves all open (candidates null).
    """
    ambiguous = sorted(set().union(*groups)) if groups else []
    first = F.try_element_at(labels, F.lit(1))
    settled = (F.size(labels) == 1) | (~first.isin(*ambiguous) if ambiguous else F.lit(True))
    parts = [F.when(F.arrays_overlap(labels, F.array(*map(F.lit, sorted(g)))), F.array(*map(F.lit, sorted(g)))).otherwise(F.array().cast("array<string>")) for g in groups]
    union = F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))) if parts else F.array().cast("array<string>")
    none = F.size(labels) == 0
    return F.struct(F.when(~none & settled, first).alias("label"), F.when(~none & ~settled, union).alias("candidates"))


# Kinds of warnings with their patterns. Level or colour is the first group.
_NUMBER = r"\s*(?:no\.?|number|#)?\s*(\d+[A-Za-z]?)\b"
WARNINGS = [
    ("TCWS", r"(?i)\b(?:Tropical\s+Cyclone\s+Wind\s+Signal|TCWS)" + _NUMBER),
    ("Public Storm Signal", r"(?i)\b(?:Public\s+Storm\s+(?:Warning\s+)?Signal|Storm\s+Signal|Typhoon\s+Signal)" + _NUMBER),
    ("Alert Level", r"(?i)\b(?:Alert\s+Level|Alert\s+Status)" + _NUMBER),
    ("Rainfall Warning", r"(?i)\b(?:(yellow|orange|red)\s+)?(?:heavy\s+)?rainfall\s+(?:warning|advisory)\b"),
    ("Flood Warning", r"(?i)\bflood\s+(?:warning|advisory|alert)()\b"),
    ("Gale Warning", r"(?i)\bgale\s+warning()\b"),
    ("Storm Surge Warning", r"(?i)\bstorm\s+surge\s+(?:warning|advisory)()\b"),
    ("Lahar Advisory", r"(?i)\blahar\s+(?:advisory|warning|alert)()\b"),
]


def warnings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind and level (upper case, or null) of each distinct warning in a text."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), F.nullif(F.upper(v), F.lit("")).alias("level")))

    found = [of_kind(*warning) for warning in WARNINGS]
    return df.select(key, F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("w")).select(key, "w.kind", "w.level")


def longest_alias(df: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """The label of the longest alias (alias, label: a small table) that a text contains; ties by alias. Texts without one are left out."""
    hit = df.select(key, F.lower(text).alias("_low")).join(F.broadcast(aliases), F.expr("contains(_low, lower(alias))"))
    return hit.groupBy(key).agg(F.max_by("label", F.struct(F.length("alias"), F.col("alias"))).alias("label"))


def nearest_label(vectors: DataFrame, key: str, vector: str, labels: dict[str, list[float]]) -> DataFrame:
    """The label whose vector has the largest cosine with a row's, with that cosine; ties by label. ``labels`` is small and constant."""
    from tidemark.functions.similarity import cosine

    scored = [F.struct(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in v])).alias("score"), F.lit(name).alias("label")) for name, v in sorted(labels.items(), reverse=True)]
    best = F.array_max(F.array(*scored))
    return vectors.select(key, best.alias("b")).select(key, "b.label", "b.score")
