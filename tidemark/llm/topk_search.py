"""Exact top-k inner-product search with a ball tree per shard.

Rows are dealt by place: a bounded sample gives at most ``CELLS`` pivots, and a row belongs to the cell of the nearest
pivot of its length. A cell is cut by hash into shards of about ``SHARD_ROWS``; each becomes a ball tree in one bounded
binary value. Queries are packed into blocks of about ``BLOCK_QUERIES`` of one cell. A first pass over one shard of its
own cell gives every query a bound, its k-th score so far. A query then travels only to the cells whose ball (pivot and
radius) can reach that bound; there it visits nodes in descending order of the upper bound q.c + |q| r and stops below
its current k-th score, which a task raises from shard to shard. Equal rows are one point with a number of copies.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, written

SCALE = 1024.0
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 4096, 1024, 64
#: Most cells, and most sampled rows and numbers in them that the pivots are worked out of.
CELLS, SAMPLE_ROWS, SAMPLE_NUMBERS = 1024, 16_384, 4_000_000
#: Queries whose current bounds a task remembers.
SHARED_QUERIES = 1 << 20
FOUND = "query_id long, query_key long, vec_id long, score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Vectors in leaf order, and for each node its centre, radius, smallest id, range of rows and two children (or -1)."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.leaves_met = 0
        order = np.arange(len(ids))
        nodes: list[tuple] = []
        todo = [(0, len(ids), -1)]
        while todo:
            begin, end, parent = todo.pop()
            own = vectors[order[begin:end]]
            centre = own.mean(axis=0)
            distance = np.linalg.norm(own - centre, axis=1)
            me = len(nodes)
            nodes.append([centre, float(distance.max()), int(ids[order[begin:end]].min()), begin, end, -1, -1])
            if parent >= 0:
                nodes[parent][5 if nodes[parent][5] < 0 else 6] = me
            if end - begin > LEAF_ROWS and distance.max() > 0:
                far = own[distance.argmax()]
                away = np.linalg.norm(own - far, axis=1)
                side = own @ (own[away.argmax()] - far)
                order[begin:end] = order[begin:end][np.argsort(side, kind="stable")]
                middle = (begin + end) // 2
                todo += [(begin, middle, me), (middle, end, me)]
        centres, radii, least, begins, ends, left, right = (np.array(c) for c in zip(*nodes, strict=True))
        self.centres, self.radii, self.least = centres, radii, least
        self.begins, self.ends, self.left, self.right = begins.tolist(), ends.tolist(), left.tolist(), right.tolist()
        self.ids, self.keys, self.copies = ids[order], keys[order], copies[order]
        self.vectors = vectors[order].astype(np.int32) if np.abs(vectors).max() < 2**31 else vectors[order]

    def search(self, ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, bounds: list[int], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best (score, vec_id) here, at most k, none below its bound; one row of the query's own is left out."""
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.linalg.norm(queries, axis=1)
            upper = queries @ self.centres.T + size[:, None] * self.radii[None, :]
            upper = np.floor(upper + 1e-3 + (np.abs(upper) + size[:, None] * np.linalg.norm(self.centres, axis=1)) * 1e-9)  # scores are whole numbers
            exact = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * queries.shape[1]
        upper = np.where(np.isnan(upper), np.inf, upper)
        if exact < 2.0**53:  # whole numbers below 2 ** 53 are exact as doubles
            vectors, asked = self.vectors.astype(np.float64), queries
        elif exact < 2.0**62:
            vectors, asked = self.vectors.astype(np.int64), queries.astype(np.int64)
        else:  # Python's whole numbers, which have no bound
            whole = lambda a: np.array([[int(x) for x in row] for row in a.tolist()], dtype=object).reshape(a.shape)
            vectors, asked = whole(self.vectors), whole(queries)
        out = []
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first
            heap = [(-upper[q, 0], 0)]
            row = upper[q]
            while heap:
                limit, node = heappop(heap)
                worst = best[0] if len(best) == k else (bounds[q], LEAST)
                if -limit < worst[0]:
                    break
                if -limit == worst[0] and -int(self.least[node]) < worst[1]:
                    continue
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        heappush(heap, (-row[child], child))
                    continue
                begin, end = self.begins[node], self.ends[node]
                self.leaves_met += 1
                scores = vectors[begin:end] @ asked[q]
                scores = np.array([min(max(s, LEAST), MOST) for s in scores.tolist()], dtype=np.int64) if scores.dtype == object else scores.astype(np.int64)
                for i in np.flatnonzero(scores >= worst[0]).tolist():
                    entry = (int(scores[i]), -int(self.ids[begin + i]))
                    own = self.keys[begin + i] == keys[q] and self.ids[begin + i] == ids[q]
                    for _ in range(min(int(self.copies[begin + i]) - own, k)):
                        if len(best) < k:
                            heappush(best, entry)
                        elif entry > best[0]:
                            heappop(best)
                            heappush(best, entry)
            out.append([(score, -minus) for score, minus in sorted(best, reverse=True)])
        return out


def _raised(bounds: list[int], best: list[list[tuple[int, int]]], k: int) -> list[int]:
    return [max(b, found[-1][0]) if len(found) == k else b for b, found in zip(bounds, best, strict=True)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of quantised numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(SCALE * np.asarray(column.flatten(), dtype=np.float64)).reshape(len(column), -1)


def _packed(rows: DataFrame, part: str, build) -> DataFrame:
    """One row for each dim, cell and ``part`` of the cell with a binary value made by ``build`` from ids, keys, copies and vectors."""

    def run(key, table):
        value = build(np.asarray(table["vec_id"]), np.asarray(table["row_key"]), np.asarray(table["copies"]), _matrix(table["embedding"]))
        return pa.table({"dim": [key[0]], "cell": [key[1]], part: [key[2]], "packed": pa.array([pickle.dumps(value)], pa.binary())})

    return rows.select("dim", "cell", part, "vec_id", "row_key", "copies", "embedding").groupBy("dim", "cell", part).applyInArrow(run, f"dim int, cell int, {part} long, packed binary")


def pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each vector length the centres of cells, numbered through all lengths in rising order; at most ``CELLS`` in all.

    They come from a few rounds of k-means over the sampled rows, those with the smallest keys. A length that the
    sample has not met has none; its rows are one cell, which is never pruned.
    """
    widest = rows.agg(F.max("dim")).first()[0] or 1
    sample = rows.orderBy("row_key", "vec_id").limit(max(16, min(SAMPLE_ROWS, SAMPLE_NUMBERS // widest))).select("dim", "embedding").toArrow()
    found: dict[int, np.ndarray] = {}
    dims = np.asarray(sample["dim"])
    for dim in np.unique(dims).tolist():
        own = _matrix(sample["embedding"].filter(pa.array(dims == dim)))
        wanted = max(1, min(round(n * len(own) / len(dims) / SHARD_ROWS), CELLS * len(own) // len(dims), len(own) // 4))
        centres = own[np.random.default_rng(7).permutation(len(own))[:wanted]]
        for _ in range(5):
            near = _nearest(own, centres)[0]
            centres = np.vstack([own[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        found[dim] = centres
    return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and how far it is."""
    near = np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * (vectors[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(vectors), 4096)])
    return near, np.linalg.norm(vectors - centres[near], axis=1)


def top_k(vectors: DataFrame, is_query=lambda vec_id: vec_id % 100 == 0, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest inner products of quantised vectors for every query.

    Each component x becomes floor(1024 x). Candidates are all rows but the query's own, repeated rows one by one; ties
    go to the smaller vec_id. Repeated query rows are ranked each. Rows with a null vec_id, a null or empty vector, or a
    component that is null or not finite, also once multiplied by 1024, take no part. A score beyond 64 bits counts as
    the nearest number of 64 bits. Only vectors of equal length are compared. Fewer than k candidates are all returned;
    an empty table, or one without queries, gives no row; other columns are left out.
    """
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < F.lit(float("inf")))))
        .withColumns({"row_key": F.xxhash64("vec_id", "embedding"), "dim": F.size("embedding")})
    )
    # Written down once: equal rows as one, with their number.
    points = written(rows.groupBy("vec_id", "row_key", "dim", "embedding").agg(F.count(F.lit(1)).alias("copies")))
    found = pivots(points, points.count())
    first_cell = dict(zip(found, np.cumsum([0, *map(len, found.values())]).tolist(), strict=False))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            cell, far = np.full(len(dims), -1, np.int32), np.full(len(dims), np.inf)
            for dim in np.unique(dims).tolist():
                if dim in found:
                    at = dims == dim
                    near, far[at] = _nearest(_matrix(batch.column(4).filter(pa.array(at))), found[dim])
                    cell[at] = near + first_cell[dim]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    shape = "dim int, vec_id long, row_key long, copies long, embedding array<double>, cell int, far double"
    placed = written(points.select("dim", "vec_id", "row_key", "copies", "embedding").mapInArrow(assign, shape))
    asks = is_query(F.col("vec_id"))
    sizes = durable(placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("asked"), F.max("far").alias("radius")))
    parted = placed.join(sizes, ["dim", "cell"])
    part = lambda count, most: F.pmod("row_key", F.greatest(F.ceil(F.col(count) / most), F.lit(1)))
    trees = durable(_packed(parted.withColumn("shard", part("n", SHARD_ROWS)), "shard", BallTree)).withColumnRenamed("packed", "tree")
    packs = _packed(parted.filter(asks).withColumn("block", part("asked", BLOCK_QUERIES)), "block", lambda ids, keys, _, v: (ids, keys, v, [LEAST] * len(ids)))
    # One shard of a cell, the first that there is, stands for it in the first pass.
    firsts = trees.groupBy("dim", "cell").agg(F.min("shard").alias("shard")).join(trees, ["dim", "cell", "shard"]).select("dim", "cell", "tree")
    # At most CELLS rows; cells without a pivot are left out, and always met.
    reach = {r["cell"]: r["radius"] for r in sizes.filter("cell >= 0").select("cell", "radius").collect()}

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, pack, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, keys, queries, bounds = pickle.loads(pack)
                bounds = np.array(_raised(bounds, pickle.loads(tree).search(ids, keys, queries, bounds, k), k), dtype=np.int64)
                cells, needed = [-1], [np.ones(len(ids), bool)]
                if dim in found:
                    cells = [c for c in range(first_cell[dim], first_cell[dim] + len(found[dim])) if c in reach]
                    centres, radii = found[dim][[c - first_cell[dim] for c in cells]], np.array([reach[c] for c in cells])
                    size = np.linalg.norm(queries, axis=1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        upper = queries @ centres.T
                        upper = upper + size[:, None] * radii + 1 + (np.abs(upper) + size[:, None] * (radii + np.linalg.norm(centres, axis=1))) * 1e-9
                    needed = list((~(upper < bounds[:, None])).T)
                for cell, own in zip(cells, needed, strict=True):
                    if own.any():
                        value = pickle.dumps((ids[own], keys[own], queries[own], bounds[own].tolist()))
                        columns = [pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([value], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "packed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: OrderedDict[tuple[int, int], int] = OrderedDict()
        for batch in batches:
            for pack, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, keys, queries, bounds = pickle.loads(pack)
                names = list(zip(ids.tolist(), keys.tolist(), strict=True))
                bounds = [max(b, shared.pop(name, b)) for b, name in zip(bounds, names, strict=True)]
                best = pickle.loads(tree).search(ids, keys, queries, bounds, k)
                shared.update(zip(names, _raised(bounds, best, k), strict=True))
                while len(shared) > SHARED_QUERIES:
                    shared.popitem(last=False)
                out = [(q, key, vec, score) for (q, key), found_here in zip(names, best, strict=True) for score, vec in found_here]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    asked = packs.join(firsts, ["dim", "cell"]).select("dim", "packed", "tree").mapInArrow(first_bounds, "dim int, cell int, packed binary")
    met = durable(asked).join(trees.select("dim", "cell", "tree"), ["dim", "cell"])
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    best = met.select("packed", "tree").mapInArrow(search, FOUND).withColumn("rank", place).filter(F.col("rank") <= k)
    # Repeated query rows get their results by a join, whose large keys Spark can split.
    queries = rows.filter(asks).select(F.col("vec_id").alias("query_id"), F.col("row_key").alias("query_key"))
    return best.join(queries, ["query_id", "query_key"]).select("query_id", "rank", "vec_id", "score")
