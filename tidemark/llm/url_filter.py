"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

Each distinct URL is expanded into every (host suffix, path prefix) expression that some rule could have; expressions
meet rules in an equi-join on the first bytes of their SHA-256 and are confirmed by the whole digest. Of the rules
that fit, the longest wins; of equally long ones, ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import copied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join uses.
SHORT = 8
#: Rules up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: With more different lengths of rule paths than this, URL paths are cut at every length up to the longest.
LENGTHS = 4096


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What stands after the host up to ``? #`` or the end; empty without ``://``. The first one counts: no way back past it."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict for each row of ``pages``.

    A null URL or one without ``://`` has an empty host and path and gets ``default``, as do URLs that no rule fits
    (``rule`` is then null). Rules with a null part are ignored; equal rules count once. Repeated rows give repeated
    results, empty tables an empty result; other columns are left out, so none can clash.
    """
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    known = (
        rules.select("host", "path", "verdict").na.drop().groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("digest", digest(F.col("host"), F.col("path")))
        .select(
            F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("rule_digest"), "rule_verdict",
            F.concat("host", "path").alias("rule"), F.length("path").alias("path_length"),
        )
    )
    # The lengths that rule paths have bound the expansion; a URL is only cut where some rule could end.
    lengths = sorted(r[0] for r in known.select("path_length").distinct().limit(LENGTHS + 1).collect())
    longest = known.agg(F.max("path_length")).first()[0] if len(lengths) > LENGTHS else 0
    few = known.select("rule").limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    known = F.broadcast(known.drop("path_length")) if few else known.drop("path_length")

    urls = (
        pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if longest:
        cuts = F.sequence(F.lit(0), F.least(F.length("path"), F.lit(longest)))
    else:
        cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(cuts, lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))
    candidates = (
        urls.select("page_id", "url", "host", "path", "copies", F.explode_outer(expressions).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
        .join(known, "short", "left")
    )
    fits = F.col("digest") == F.col("rule_digest")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("length"), "rule_verdict", "rule"))).alias("best")
    return (
        copied(candidates.groupBy("page_id", "url", "host", "path", "copies").agg(best), "copies")
        .select(
            "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        )
    )
