"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has a bit set if more than half of the hashes of a text's word shingles have it. Bits are given random
vectors of ``RADIUS + 1`` bits; each non-zero vector v makes a mask of the bits whose vectors have an odd product with
v. For any two fingerprints at most ``RADIUS`` bits apart, some mask leaves out all differing bits, so both meet in the
bucket of that mask's table. Equal fingerprints are one node from the start. The nodes of a bucket with more than
``CROWDED`` of them are dealt again, by a second set of masks over the bits that the first mask leaves open; at most 18 bits
are then left, so no bucket can hold more than 2 ** 18 nodes, whatever the input. A bucket is read in order of its
key and yields no more links than it has nodes; groups are the connected components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, durable, renamed, small_batches, written
from tidemark.operators.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
FINGERPRINTS = "doc_id long, bits long"
#: Nodes from which on a bucket is dealt again.
CROWDED = 8192
#: Nodes whose pairs are looked at together, at most.
BLOCK_PAIRS = 1 << 19
#: Vectors of the bits, drawn once for either set of masks; every run uses the same tables.
_VECTORS = [np.random.default_rng(seed).permutation(np.tile(np.arange(1, 2 ** (RADIUS + 1)), 5))[:64] for seed in (20240229, 55)]


def masks(which: int = 0) -> list[int]:
    """The 64-bit masks of the covering tables, of the first or the second set."""
    odd = lambda a: bin(a).count("1") & 1
    return [sum(1 << i for i, m in enumerate(_VECTORS[which].tolist()) if odd(m & v)) for v in range(1, 2 ** (RADIUS + 1))]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # splits at the six ASCII white-space bytes, lowers A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :] or ends[-1:], strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number, for each row, and the columns named in ``keep``."""
    carried, schema = beside(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            bits = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), *batch.columns[2:]], names=["doc_id", "bits", *batch.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried)
    return renamed(rows.mapInArrow(run, FINGERPRINTS + schema), keep)


def bucket_links(nodes: np.ndarray) -> np.ndarray:
    """For each node of a bucket, the smallest position in the bucket that short steps of ``RADIUS`` bits or fewer lead to."""
    n = len(nodes)
    root = np.arange(n)
    rows = max(1, BLOCK_PAIRS // n)
    for i in range(0, n, rows):
        a, b = np.nonzero(np.bitwise_count(nodes[i : i + rows, None] ^ nodes[None, i:]) <= RADIUS)
        later = b > a
        a, b = a[later] + i, b[later] + i
        while len(a):  # hooks the larger root of each pair onto the smaller one until all pairs agree
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return root


def covering_links(nodes: DataFrame, column: str = "bits") -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs of distinct ``column`` values within ``RADIUS`` bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = lambda which, shift: F.array(*[F.struct(F.lit(t + shift).alias("t"), F.col("bits").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(which))])
    dealt = nodes.select(F.col(column).alias("bits"), F.explode(keys(0, 0)).alias("at")).select("at.t", "at.key", "bits")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    # Few buckets are crowded, and none if fingerprints are spread. As a table their size is known, so that few are broadcast.
    crowded = written(sizes.filter(F.col("n") > CROWDED).select("t", "key", F.lit(True).alias("crowded")))
    again = F.when(F.col("crowded"), keys(1, 1)).otherwise(F.array(F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("key"))))
    placed = dealt.join(crowded, ["t", "key"], "left").select("t", "key", "bits", F.explode(again).alias("again")).select("t", "key", F.col("again.t").alias("u"), F.col("again.key").alias("within"), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the bucket that the last batch ended in

        def links(rows: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero((np.diff(rows[:, :4], axis=0) != 0).any(axis=1)) + 1
            out = [np.zeros((0, 2), np.int64)]
            bounds = np.concatenate([[0], edges, [len(rows)]])
            for i in np.flatnonzero(np.diff(bounds) > 1):
                own = rows[bounds[i] : bounds[i + 1], 4]
                root = bucket_links(own.view(np.uint64))
                moved = np.flatnonzero(root != np.arange(len(own)))
                out.append(np.column_stack([own[moved], own[root[moved]]]))
            pairs = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1, initial=np.iinfo(np.int64).min)), pa.array(pairs.min(axis=1, initial=np.iinfo(np.int64).max))], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns])
            if not len(rows):
                continue
            last = (rows[:, :4] == rows[-1, :4]).all(axis=1)
            cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield links(np.concatenate([*held, rows[:cut]]))
                held = []
            elif held and (held[-1][-1, :4] != rows[0, :4]).any():
                yield links(np.concatenate(held))
                held = []
            held.append(rows[cut:])
        if held:
            yield links(np.concatenate(held))

    place = ["t", "key", "u", "within"]
    return placed.repartition(*place).sortWithinPartitions(*place, "bits").mapInArrow(run, "a long, b long")


def named_groups(marked: DataFrame) -> DataFrame:
    """bits, least (its smallest doc_id) and component of each distinct fingerprint."""
    nodes = durable(marked.groupBy("bits").agg(F.min("doc_id").alias("least")))
    groups = connected_components(covering_links(nodes))
    named = nodes.join(groups, nodes["bits"] == groups["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    return durable(named)


def first_rows(docs: DataFrame, row: str, digest: str) -> DataFrame:
    """``row``, a number that no two rows share, of one row of each group: the smallest doc_id (null last), then ``digest``."""
    marked = durable(fingerprints(docs, (row, digest)))
    named = named_groups(marked).select("bits", "component")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", digest, row)
    firsts = marked.groupBy("bits").agg(F.min(place).alias("first"))
    return firsts.join(named, "bits").groupBy("component").agg(F.min("first").alias("first")).select(F.col(f"first.{row}").alias(row))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id of the group) for each row.

    A null or empty text has fingerprint zero and is linked like any other. Rows with a null doc_id are fingerprinted
    and can join groups but never name one (component_id is null if all of a group's ids are). Repeated rows give a
    row each; an empty table gives none; other columns are left out.
    """
    marked = durable(fingerprints(docs))
    named = named_groups(marked)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.select("bits", "component").join(least, "component").select("bits", "component_id")
    return marked.join(names, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
