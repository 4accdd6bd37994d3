"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node that it is linked with, over any number of links).

    ``links`` has two columns of numbers. Every node of a link comes out once; loops, repeated and reversed links do no
    harm, rows with a null are ignored, and no links give no nodes. Each round links every node's larger neighbours,
    then every node and its smaller neighbours, to the least of them; it ends when a round changes nothing. A round
    only groups with partial sums and joins on the node, so that Spark can split the rows of a large star.
    """
    first, second = links.columns[:2]
    pairs = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"), (F.col(first) + F.lit(0)).alias("x"), (F.col(second) + F.lit(0)).alias("y"))
    edges = durable(pairs.filter("x IS NOT NULL AND y IS NOT NULL AND a <> b").select("a", "b").distinct())
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = durable(small.filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    named = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return named.unionByName(roots)
