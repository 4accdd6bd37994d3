"""Hierarchies and paths: closures, roots, parent resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable, written


def path_closure(edges: DataFrame, child: str = "child", parent: str = "parent", most_depth: int = 64) -> DataFrame:
    """Path ``+`` over an edge table: descendant, ancestor, depth (the shortest, from 1). Cycles end where they began.

    Every round joins the pairs found last with the edges and leaves out pairs found before, so it stops on any input;
    rows with a null are no edges.
    """
    steps = edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).na.drop().distinct()
    found = frontier = durable(steps.withColumn("depth", F.lit(1)))
    nexts = steps.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("above"))
    for depth in range(2, most_depth + 1):
        if frontier.isEmpty():
            return found
        grown = frontier.join(nexts, "ancestor").select("descendant", F.col("above").alias("ancestor")).distinct()
        frontier = durable(grown.join(found, ["descendant", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    if not frontier.isEmpty():
        raise RuntimeError("paths are longer than most_depth")
    return found


def reached(edges: DataFrame, starts: DataFrame, child: str = "child", parent: str = "parent", most_depth: int = 64) -> DataFrame:
    """Path ``+`` from some nodes only (the starts' one column): start, node. Cycles end where they began.

    A round moves no edge from outside the range of the nodes found last, and looks for pairs found before only among
    rounds whose ranges overlap; so edges between nodes of one kind and the next are moved once.
    """
    steps = edges.select(F.col(child).alias("node"), F.col(parent).alias("above")).na.drop()
    rounds: list[tuple[str, str, DataFrame]] = []
    edge = starts.toDF("start").na.drop().distinct().select("start", F.col("start").alias("node"))
    for depth in range(most_depth + 1):
        edge = written(edge)
        low, high = edge.agg(F.min("node"), F.max("node")).first()
        known = [df for a, b, df in rounds if low is not None and a <= high and low <= b]
        if known:
            for df in known:
                edge = edge.join(df, ["start", "node"], "left_anti")
            edge = written(edge)
            low, high = edge.agg(F.min("node"), F.max("node")).first()
        if low is None:
            break
        if depth:
            rounds.append((low, high, edge))
        edge = edge.join(steps.filter(F.col("node").between(low, high)), "node").select("start", F.col("above").alias("node")).distinct()
    else:
        raise RuntimeError("paths are longer than most_depth")
    found = edge  # of the last round, without rows
    for _, _, df in rounds:
        found = found.unionByName(df)
    return found


#: Levels of a tree that are joined in one plan; deeper ones and cycles take the general way.
LEVELS = 6


def closure(nodes: DataFrame, key: str, parent: str, most_depth: int = 64) -> DataFrame:
    """Path ``*`` over a node table with parents: as ``path_closure``, and every node with itself at depth 0.

    Hierarchies are shallow, so a row for each node gathers its ancestors level by level in one plan.
    """
    own = nodes.select(F.col(key).alias("up0")).na.drop().distinct()
    parents = nodes.select(F.col(key).alias("child"), F.col(parent).alias("up")).na.drop().distinct()
    wide = own
    for i in range(LEVELS + 1):
        wide = wide.join(parents.select(F.col("child").alias(f"up{i}"), F.col("up").alias(f"up{i + 1}")), f"up{i}", "left")
    wide = durable(wide)
    if wide.filter(f"up{LEVELS + 1} IS NOT NULL").isEmpty():
        ups = F.array(*[F.struct(F.col(f"up{i}").alias("ancestor"), F.lit(i).alias("depth")) for i in range(LEVELS + 1)])
        pairs = wide.select(F.col("up0").alias("descendant"), F.explode(ups).alias("u")).filter("u.ancestor IS NOT NULL")
        return pairs.groupBy("descendant", F.col("u.ancestor").alias("ancestor")).agg(F.min("u.depth").alias("depth"))
    selves = own.select(F.col("up0").alias("descendant"), F.col("up0").alias("ancestor"), F.lit(0).alias("depth"))
    return selves.unionByName(path_closure(nodes, key, parent, most_depth).filter("descendant <> ancestor"))


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Each node's ancestor without a parent: id, root."""
    tops = nodes.filter(F.col(parent).isNull()).select(F.col(key).alias("ancestor"))
    return closure(nodes, key, parent).join(tops, "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("ancestor").alias("root"))


def place_parent(code, level):
    """The parent code of a ten-digit place code by its level, before looking whether that parent exists."""
    cut = lambda n: F.rpad(F.substring(code, 1, n), 10, "0")
    return (
        F.when(level == "Bgy", cut(7)).when(level == "SubMun", cut(5)).when(level.isin("City", "Mun"), cut(5)).when(level == "Prov", cut(2))
    )


def resolve_parents(places: DataFrame) -> DataFrame:
    """places (code, level) with parent: the province of a city, or its region if that is itself or unknown."""
    known = places.select(F.col("code").alias("candidate"), F.lit(True).alias("known"))
    region = F.rpad(F.substring("code", 1, 2), 10, "0")
    named = places.withColumn("candidate", place_parent(F.col("code"), F.col("level"))).join(known, "candidate", "left")
    ok = F.col("known") & (F.col("candidate") != F.col("code"))
    return named.withColumn("parent", F.when(F.col("level") == "Reg", None).when(ok, F.col("candidate")).when(region != F.col("code"), region)).drop("candidate", "known")


#: Levels of places.
PLACE_LEVELS = ["Reg", "Prov", "City", "Mun", "SubMun", "Bgy"]


def clean_places(cells: DataFrame, headers: dict[str, str], blank: str = "note") -> DataFrame:
    """A table of places out of its sheet: the first nameless column is named ``blank``, codes have ten digits, empty texts
    are null, and rows of no known level go."""
    names, nameless = [], True
    for c in cells.columns:
        empty = not c.strip() or c.startswith("_c")
        names.append(blank if empty and nameless else headers.get(c, c))
        nameless = nameless and not empty
    named = cells.toDF(*names)
    texts = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in named.columns}
    return named.withColumns(texts | {"code": F.lpad(F.trim(F.col("code").cast("string")), 10, "0")}).filter(F.col("level").isin(*PLACE_LEVELS))


def search_tree(nodes: DataFrame, key: str, label: str, parent: str, text: str) -> DataFrame:
    """The nodes whose label has a text in it (matched) and all that they lie below: what a tree shows for a search."""
    hit = nodes.filter(F.contains(F.lower(label), F.lit(text.lower()))).select(F.col(key).alias("descendant"))
    shown = closure(nodes, key, parent).join(hit, "descendant", "left_semi").groupBy(F.col("ancestor").alias(key)).agg(F.max(F.col("depth") == 0).alias("matched"))
    return nodes.join(shown, key)
