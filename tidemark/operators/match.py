"""Fuzzy joins to dimensions: exact by normalised name first, similarity on what is left."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import best_ratio, sort_ratio, sorted_tokens, token_sort_ratio, weighted_ratio
from tidemark.functions.strings import folded, substitute


def name_key(name: Column) -> Column:
    """A name without accents, case and punctuation; an underscore is a space, as names in tables have it."""
    return folded(F.translate(name, "_", " "))


def match_names(queries: DataFrame, names: DataFrame, least: float = 0.79, exact_ratio: bool = False) -> DataFrame:
    """queries (query) with id and score of the best of ``names`` (name, id, pos); null below ``least``.

    Distinct queries are matched once. Equal folded names score 1. For the rest the score is the token sort ratio, or
    with ``exact_ratio`` the largest of the three token ratios, which needs every pair. The best score wins, then the
    smallest pos.
    """
    asked = queries.select("query").distinct().withColumn("q", name_key(F.col("query")))
    known = names.select("id", "pos", name_key(F.col("name")).alias("n"))
    first = known.groupBy("n").agg(F.min_by("id", "pos").alias("id"))
    exact = asked.join(first, F.col("q") == F.col("n")).select("query", "id", F.lit(1.0).alias("score"))
    left = asked.join(exact.select("query"), "query", "left_anti")
    scored = left.crossJoin(known).withColumn("score", best_ratio(F.col("q"), F.col("n"))).filter(F.col("score") >= least) if exact_ratio else near_names(left, known, least)
    fuzzy = scored.groupBy("query").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("pos"))).alias("b")).select("query", "b.id", "b.score")
    return queries.join(exact.unionByName(fuzzy), "query", "left")


def match_places(texts: DataFrame, places: DataFrame, least: float = 0.85) -> DataFrame:
    """texts (text: parts from narrow to wide, comma-separated) with the code of the narrowest part that matches.

    ``places`` has code, label and parent. The widest part is matched among all places; each narrower one among the
    places below the match so far, or among all if nothing matched.
    """
    from tidemark.operators.hierarchy import closure

    below = closure(places, "code", "parent").filter("depth > 0")
    parts = texts.select("text").distinct().select("text", F.posexplode(F.reverse(F.filter(F.transform(F.split("text", ","), lambda p: F.trim(p)), lambda p: p != ""))).alias("tier", "part"))
    labels = places.select(F.col("code").alias("id"), F.col("label").alias("name"))
    candidates = match_all(parts.select(F.col("part").alias("query")), labels, least)
    found = parts.join(candidates, parts["part"] == candidates["query"]).select("text", "tier", "id", "score")
    inner, outer = found.alias("i"), found.alias("o")
    inside = below.select(F.col("descendant").alias("d"), F.col("ancestor").alias("u"))
    supported = inner.join(outer, (F.col("i.text") == F.col("o.text")) & (F.col("i.tier") == F.col("o.tier") + 1)).join(inside, (F.col("i.id") == F.col("d")) & (F.col("o.id") == F.col("u"))).select("i.text", "i.tier", "i.id", "i.score", F.lit(1).alias("held"))
    ranked = found.withColumn("held", F.lit(0)).unionByName(supported)
    best = ranked.groupBy("text").agg(F.max_by("id", F.struct("held", "tier", "score", "id")).alias("code"))
    return texts.join(best, "text", "left")


def match_all(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """Every id with a name at least ``least`` like the query, and the score of the best of its names: query, id, score."""
    asked = queries.select("query").distinct().withColumn("q", name_key(F.col("query")))
    known = names.select("id", name_key(F.col("name")).alias("n"))
    return near_names(asked, known, least).groupBy("query", "id").agg(F.max("score").alias("score"))


def near_names(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Every pair of a row with q and a row with n whose token sort ratio is ``least`` (above 0) or more, and the ratio as score.

    No such pair is lost: it has 2 * min(lengths) >= ``least`` * sum(lengths), so pairs meet by length; and it differs by at most
    (1 - ``least``) * sum(lengths) inserted or deleted characters, so by no more edits. The names are the smaller side.
    """
    bound = least / (2 - least)
    size = F.length("t")
    lengths = F.sequence(F.ceil(size * bound - 1e-6).cast("int"), F.floor(size / bound + 1e-6).cast("int"))
    names = known.withColumn("t", sorted_tokens(F.col("n"))).filter("t IS NOT NULL").withColumn("block", F.explode(lengths))
    queries = asked.withColumn("s", sorted_tokens(F.col("q"))).withColumn("block", F.length("s"))
    met = queries.join(names, "block").filter(F.levenshtein("s", "t") <= (1 - least) * (F.length("s") + F.length("t")) + 1e-6)
    return met.withColumn("score", sort_ratio(F.col("s"), F.col("t"))).filter(F.col("score") >= least).drop("block", "s", "t")


#: Names that a query is held against one by one, at most; they travel with the task.
MOST_NAMES = 50_000


def match_flat(texts: DataFrame, places: DataFrame, aliases: dict[str, str], broad: dict[str, list[str]] | None = None, least: float = 0.80) -> DataFrame:
    """texts (text) with codes (a list), the name that fits and the score, of the places (name, code) of any level.

    Aliases (name in lower case: code) come first. A text ``X City`` is looked for as ``City of X``, and only if that finds
    nothing as it is. The score is the better of the weighted and the token sort ratio. Texts that nothing fits get the
    codes of the first ``broad`` word (in lower case) that they hold. Distinct texts are matched once; ``places`` has at
    most ``MOST_NAMES`` names, or this raises ValueError.
    """
    names = [tuple(r) for r in places.select("name", "code").filter("name IS NOT NULL").orderBy("name", "code").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    low = [(name.lower(), name, code) for name, code in names]

    def best(text: str) -> tuple[float, str, str] | None:
        scored = ((max(weighted_ratio(text, n), token_sort_ratio(text, n)), name, code) for n, name, code in low)
        found = max(scored, key=lambda s: s[0], default=None)
        return found if found and found[0] >= least else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                said = text.strip().lower()
                city = re.fullmatch(r"(.+?)\s+city", said)
                if said in aliases:
                    rows.append((text, [aliases[said]], said, 1.0))
                elif found := (city and best(f"city of {city[1]}")) or best(said):
                    rows.append((text, [found[2]], found[1], found[0]))
                else:
                    word = next((w for w in broad or {} if w in said), None)
                    rows.append((text, (broad or {}).get(word), word, None))
            yield pd.DataFrame(rows, columns=["text", "codes", "name", "score"])

    distinct = texts.select("text").filter("text IS NOT NULL AND trim(text) <> ''").distinct()
    return texts.join(distinct.mapInPandas(run, "text string, codes array<string>, name string, score double"), "text", "left")


# Abbreviations in names of places.
PLACE_WORDS = [(r"\bsta\.?", "santa"), (r"\bsto\.?", "santo"), (r"\bgen\.?", "general"), (r"\bbrgy\.?", "barangay"), (r"\bpob\.?", "poblacion"), (r"\bpurok\.?", "purok"), (r"\bmt\.?", "mount")]


def place_label(cell: Column) -> Column:
    """A place's name in lower case with its abbreviations written out."""
    return substitute(F.lower(F.trim(cell)), PLACE_WORDS)
