"""Removal of repeated passages: every byte of a 50-byte string that also starts in a document with a smaller doc_id.

Documents are dealt into groups by hash of doc_id and text; a group is a few megabytes of text. Every 50-byte string holds an
anchor: the ``ANCHOR`` bytes with the smallest hash among those inside it, so two equal strings have equal anchors at
equal places. What a string needs to know about others is found among the surroundings (``REACH`` bytes on either side)
of equal anchors, dealt by hash of the anchor into buckets:

1. groups send the short hashes of their anchors, and learn which occur in several groups;
2. of those, they send anchor, hash of the surroundings and smallest doc_id, and learn the smallest doc_id of all equal
   surroundings, of which one occurrence stands for all;
3. where one anchor has different surroundings, these are sent; a bucket sorts the suffixes of shards of them, merges
   the shards' Burrows-Wheeler transforms by interleave refinement and reads off the repeated intervals, for which the
   smallest doc_id tells which strings come again.

Each step moves one packed value for each group and bucket that have something to say to each other. Texts are
shuffled once: all steps use the same exchange.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bwt import Strings, merge_transforms
from tidemark.llm.common import beside, renamed, text_bytes

LENGTH, ANCHOR = 50, 32
REACH = LENGTH - ANCHOR
REGION = REACH + ANCHOR + REACH
#: Least and most bytes of text in a group, and the text that anchors are looked for in at once.
GROUP_BYTES, MOST_GROUP_BYTES, CHUNK_BYTES = 4 << 20, 128 << 20, 1 << 18
#: Surroundings merged at once, and those of one anchor from which windows are compared one offset at a time instead.
SLICE_STRINGS, MOST_STRINGS = 8_000, 60_000
#: Surroundings that are copied out of the texts at once.
SURROUNDINGS = 8192
NOBODY = np.iinfo(np.int64).max
_ODD = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were ever asked for."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            bases = np.full((2, size), [[_ODD], [pow(_ODD, -1, 1 << 64)]], dtype=np.uint64)
            bases[:, 0] = 1
            cls.up, cls.down = np.cumprod(bases, axis=1, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    n, c = 1, a
    while 2 * n <= width:
        c = best(c[:-n], c[n:])
        n *= 2
    return best(c[: len(a) - width + 1], c[width - n :][: len(a) - width + 1]) if n < width else c


def anchors(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of texts joined in ``data``: place, owner, hash, hash of the surroundings, bytes to the left and right.

    The surroundings are cut at the ends of the text.
    """
    # Groups are far below 2 ** 31 bytes, unless one text is longer.
    place = np.int32 if len(data) < 2**31 - REGION else np.int64
    kinds = {"place": place, "owner": np.int32, "hash": np.uint64, "around": np.uint64, "left": np.int16, "right": np.int16}
    found: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES, side="right")) - 1)
        base = int(starts[first])
        text, own = data[base : int(starts[last])], starts[first : last + 1] - base
        if len(text) >= LENGTH:
            up, down = _Powers.of(len(text) + 1)
            summed = np.zeros(len(text) + 1, dtype=np.uint64)
            np.cumsum(_VALUES[text] * up[:-1], out=summed[1:])
            key = _mix((summed[ANCHOR:] - summed[:-ANCHOR]) * down[: len(summed) - ANCHOR])
            least = _sliding(key, REACH + 1, np.minimum)
            crossing = (own[1:, None] - np.arange(1, LENGTH)).ravel()
            least[crossing[(crossing >= 0) & (crossing < len(least))]] = 0  # strings that leave their text
            padded = np.zeros(len(least) + 2 * REACH, dtype=np.uint64)
            padded[REACH:-REACH] = least
            at = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == key)
            owner = np.searchsorted(own, at, side="right") - 1
            left, right = np.minimum(at - own[owner], REACH), np.minimum(own[owner + 1] - at - ANCHOR, REACH)
            a, b = at - left, at + ANCHOR + right
            around = _mix((summed[b] - summed[a]) * down[a] + (left * 64 + right + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            for k, v in (("place", at + base), ("owner", owner + first), ("hash", key[at]), ("around", around), ("left", left), ("right", right)):
                found[k].append(v.astype(kinds[k]))
        first = last
    return {k: np.concatenate([np.zeros(0, kinds[k]), *v]) for k, v in found.items()}


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, in which Spark's compression finds the empty ones."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes() if len(numbers) else b""


def _numbers(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel() if planes else np.zeros(0, kind)


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each run of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    return [(int(bucket[a]), a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def _sent(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names.split(), columns, kinds, strict=True)})


class Group:
    """The documents of a group in order of doc_id, their anchors, and what buckets have told it so far."""

    def __init__(self, docs: pa.Table, told: pa.Table | None, buckets: int):
        docs = docs.sort_by([("place_of", "ascending"), ("salt", "ascending")]).combine_chunks()
        self.docs = docs
        self.key = np.asarray(docs["place_of"]).astype(np.int64)
        self.data, self.starts, _ = text_bytes(docs["text"])
        self.anchors = anchors(self.data, self.starts)
        self.buckets = buckets
        self.bucket = ((self.anchors["hash"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        short = self.anchors["hash"] & np.uint64(0xFFFFFFFF)
        self.short, self.short_of, self.times = np.unique(self.bucket.astype(np.uint64) << np.uint64(32) | short, return_inverse=True, return_counts=True)
        self.short_of = self.short_of.astype(np.int32)
        self.told: dict[int, list[bytes]] = {}
        if told is not None:
            told = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
            for kind, value in zip(told["kind"].to_pylist(), told["value"].to_pylist(), strict=True):
                self.told.setdefault(kind, []).append(value)

    def short_hashes(self) -> list[tuple[int, bytes]]:
        bucket = (self.short >> np.uint64(32)).astype(np.int64)
        return [(b, _planes((self.short[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32))) for b, i, j in _parts(bucket)]

    def classes(self) -> None:
        """Anchors that occur again, in order of bucket, anchor, surroundings and document, and the classes of equal ones."""
        again = self.times > 1
        if told := self.told.get(0):
            sizes = [j - i for _, i, j in _parts((self.short >> np.uint64(32)).astype(np.int64))]
            again |= np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n).astype(bool) for v, n in zip(told, sizes, strict=True)])
        at = np.flatnonzero(again[self.short_of])
        a = self.anchors
        at = at[np.lexsort((a["place"][at], a["around"][at], a["hash"][at], self.bucket[at]))]
        self.at = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (a["hash"][at][1:] != a["hash"][at][:-1]) | (a["around"][at][1:] != a["around"][at][:-1])
        self.class_of = np.cumsum(fresh) - 1
        self.first = at[fresh]  # the occurrence with the smallest doc_id

    def class_hashes(self) -> list[tuple[int, bytes]]:
        self.classes()
        a, f = self.anchors, self.first
        table = np.column_stack([a["hash"][f], a["around"][f], self.key[a["owner"][f]].view(np.uint64)])
        return [(b, b"".join([_planes(table[i:j, c].copy()) for c in range(3)])) for b, i, j in _parts(self.bucket[f])]

    def answers(self) -> None:
        """The smallest doc_id of each class among all groups, and whether this group is to send its surroundings."""
        self.classes()
        least, asked = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for value, (_, i, j) in zip(self.told.get(1, []), _parts(self.bucket[self.first]), strict=True):
            n = j - i
            least.append(_numbers(value[: 8 * n], np.int64))
            asked.append(np.unpackbits(np.frombuffer(value[8 * n :], np.uint8), count=n).astype(bool))
        self.least, self.asked = np.concatenate(least), np.concatenate(asked)

    def surroundings(self) -> list[tuple[int, bytes]]:
        self.answers()
        a, f = self.anchors, self.first[self.asked]
        content = np.zeros((len(f), REGION), np.uint8)
        for i in range(0, len(f), SURROUNDINGS):  # the places of all bytes at once would take eight times their room
            own = f[i : i + SURROUNDINGS]
            place, left, right = (a[c][own][:, None] for c in ("place", "left", "right"))
            span = place - REACH + np.arange(REGION)[None, :]
            inside = (span >= place - left) & (span < place + ANCHOR + right)
            content[i : i + SURROUNDINGS] = np.where(inside, self.data[np.clip(span, 0, len(self.data) - 1)], 0)
        ends = (a["left"][f] * 64 + a["right"][f]).astype(np.uint16)
        keys = self.key[a["owner"][f]]
        return [(b, _planes(keys[i:j]) + ends[i:j].tobytes() + content[i:j].tobytes()) for b, i, j in _parts(self.bucket[f])]

    def covered(self) -> np.ndarray:
        """Whether each byte of the group's texts is to go."""
        self.answers()
        a = self.anchors
        masks = np.zeros(len(self.first), dtype=np.int64)
        if told := self.told.get(2):
            masks[self.asked] = np.concatenate([np.frombuffer(v, "<u4") for v in told])
        places, keys = a["place"][self.at], self.key[a["owner"][self.at]]
        later = keys > self.least[self.class_of]
        begin = [places[later] - a["left"][self.at][later]]
        end = [places[later] + ANCHOR + a["right"][self.at][later]]
        rest = np.flatnonzero(~later & (masks[self.class_of] > 0))
        for o in range(REACH + 1):
            own = rest[masks[self.class_of[rest]] >> o & 1 > 0]
            start = places[own] - a["left"][self.at[own]] + o
            begin.append(start)
            end.append(start + LENGTH)
        # A byte lies in the surroundings and windows of few anchors, so depths are small numbers.
        depth = np.zeros(len(self.data) + 1, dtype=np.int16)
        for own in begin:
            np.add.at(depth, own, 1)
        for own in end:
            np.subtract.at(depth, own, 1)
        return np.cumsum(depth[:-1], dtype=np.int16, out=depth[:-1]) > 0

    def result(self, whole_characters: bool = False) -> pa.Table:
        gone = self.covered()
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        inner = self.starts[:-1][np.diff(self.starts) > 0]
        rises[inner] = gone[inner]

        def total(flags: np.ndarray) -> np.ndarray:
            """How many flags of each text are set."""
            so_far = np.zeros(len(flags) + 1, dtype=np.int32 if len(flags) < 2**31 else np.int64)
            np.cumsum(flags, dtype=so_far.dtype, out=so_far[1:])
            return np.diff(so_far[self.starts]).astype(np.int64)

        removed, spans = total(gone), total(rises)
        raw = self.data
        parts = list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), removed.tolist(), strict=True))
        kept = [raw[i:j][~gone[i:j]].tobytes() if n else raw[i:j].tobytes() for i, j, n in parts]
        remaining = kept
        if whole_characters:
            remaining = [raw[i:j][~touched_characters(raw[i:j], gone[i:j])].tobytes() if n else k for (i, j, n), k in zip(parts, kept, strict=True)]
        return pa.table({
            "doc_id": self.docs["doc_id"], "n_bytes": pa.array(np.diff(self.starts)), "n_removed": pa.array(removed), "n_spans": pa.array(spans),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "remaining": pa.array(remaining, pa.binary()),
        } | {c: self.docs[c] for c in self.docs.column_names if c.startswith("carried_")})


def touched_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Whether each byte of a text belongs to a code point that has a byte in ``gone``. Only the ends of runs are looked at."""
    out = gone.copy()
    inner = (data & 0xC0) == 0x80  # bytes that go on with a code point
    for _ in range(3):  # a code point has at most four bytes
        out[:-1] |= out[1:] & inner[1:]
        out[1:] |= out[:-1] & inner[1:]
    return out


def repeated_windows(content: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each surroundings, bit o is set if the 50 bytes from its o-th byte on are in one with a smaller doc_id.

    ``content`` has rows of ``REGION`` bytes with the anchor in the middle. Equal anchors stand together and are one
    symbol in the strings that are merged, so ``REACH + 1`` symbols are a window.
    """
    masks = np.zeros(len(keys), dtype=np.int64)
    anchor = np.ascontiguousarray(content[:, REACH : REACH + ANCHOR]).view(f"V{ANCHOR}").ravel()
    _, number = np.unique(anchor, return_inverse=True)
    order = np.argsort(number, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]])
    slices, begin = [], 0
    for i in range(1, len(bounds)):
        if i + 1 == len(bounds) or bounds[i + 1] - bounds[begin] > SLICE_STRINGS:
            slices.append((int(bounds[begin]), int(bounds[i])))
            begin = i
    for i, j in slices:
        own = order[i:j]
        if j - i > MOST_STRINGS:
            masks[own] = _by_offset(content[own], left[own], right[own], keys[own])
        elif j - i > 1:
            masks[own] = _by_merging(content[own], left[own], right[own], keys[own], number[own] - number[own[0]])
    return masks


def _by_merging(content: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    n = len(keys)
    symbols = np.zeros((n, 2 * REACH + 1), dtype=np.uint16)
    symbols[:, :REACH] = content[:, :REACH]
    symbols[:, REACH + 1 :] = content[:, REACH + ANCHOR :]
    symbols += 1
    symbols[:, REACH] = 257 + anchor
    column = np.arange(2 * REACH + 1)[None, :]
    inside = (column >= REACH - left[:, None]) & (column <= REACH + right[:, None])
    strings = Strings(symbols[inside], left + 1 + right)
    places, common = merge_transforms(strings, REACH + 1)
    owner, offset = strings.owner[places], strings.offset[places]
    whole = (offset <= left[owner]) & (offset + REACH + 1 <= strings.lengths[owner])
    key = np.where(whole, keys[owner], NOBODY)
    # A repeated interval is a maximal run of suffixes whose common prefixes with their neighbours are whole windows.
    first = np.flatnonzero(common < REACH + 1)
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.concatenate([first, [len(common)]])))
    again = whole & (least < key)
    return np.bincount(owner[again], weights=1 << offset[again], minlength=n).astype(np.int64)


def _by_offset(content: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The same for any number of surroundings of one anchor, in the memory of one sort."""
    masks = np.zeros(len(keys), dtype=np.int64)
    for o in range(REACH + 1):  # windows that start o bytes before the anchor
        own = np.flatnonzero((left >= o) & (right >= REACH - o))
        if len(own) < 2:
            continue
        windows = np.ascontiguousarray(content[own, REACH - o : REACH - o + LENGTH]).view(f"V{LENGTH}").ravel()
        _, group = np.unique(windows, return_inverse=True)
        least = np.full(group.max() + 1, NOBODY)
        np.minimum.at(least, group, keys[own])
        again = least[group] < keys[own]
        masks[own[again]] |= 1 << (left[own[again]] - o)
    return masks


def group_bytes(volume: int) -> int:
    """Bytes of text in a group: more for large corpora, since every group may have something to tell every bucket."""
    return min(MOST_GROUP_BYTES, max(GROUP_BYTES, math.isqrt(volume * 4096)))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining bytes of every row, and the columns in ``keep``.

    With ``whole_characters`` the remaining bytes are those of whole code points: one that lost a byte goes as a whole,
    and nothing else does. The other columns count bytes as they are. Texts are UTF-8 bytes (null: empty); matches never cross documents, and strings are judged on the input. Rows with
    a null doc_id count as larger than all others; rows that share a doc_id are not smaller than one another. Texts
    under 50 bytes lose nothing; an empty table gives no row; other columns are left out.
    """
    spark = docs.sparkSession
    carried, carried_schema = beside(docs, keep)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *carried)
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(parts, math.ceil(volume / group_bytes(volume))), max(parts, math.ceil(volume / (4 * group_bytes(volume))))
    place = F.coalesce("doc_id", F.lit(NOBODY - 1))
    dealt = rows.select(F.pmod(F.xxhash64(place, "text"), F.lit(groups)).cast("int").alias("g"), place.alias("place_of"), F.xxhash64("text").alias("salt"), *rows.columns)
    to_bucket = "bucket int, g int, value binary"
    to_group = "g int, kind int, bucket int, value binary"
    sent_kinds, told_kinds = [pa.int32(), pa.int32(), pa.binary()], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    by_group = dealt.groupBy("g")

    def sending(step: str):
        def send(key, left, right):
            g = key[0].as_py()
            return _sent([(b, g, v) for b, v in getattr(Group(left, right, buckets), step)()], "bucket g value", sent_kinds)

        return send

    def first(key, left):
        return _sent([(b, key[0].as_py(), v) for b, v in Group(left, None, buckets).short_hashes()], "bucket g value", sent_kinds)

    def which_again(key, table):
        own = [_numbers(v, np.uint32) for v in table["value"].to_pylist()]
        merged = np.sort(np.concatenate(own))
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        out = []
        for g, hashes in zip(table["g"].to_pylist(), own, strict=True):
            flags = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes if len(twice) else np.zeros(len(hashes), bool)
            out.append((g, 0, key[0].as_py(), np.packbits(flags).tobytes()))
        return _sent(out, "g kind bucket value", told_kinds)

    def least_of_class(key, table):
        values, groups_of = table["value"].to_pylist(), table["g"].to_pylist()
        sizes = [len(v) // 24 for v in values]
        column = lambda c, kind: np.concatenate([_numbers(v[8 * n * c : 8 * n * (c + 1)], kind) for v, n in zip(values, sizes, strict=True)])
        anchor, around, doc = column(0, np.uint64), column(1, np.uint64), column(2, np.int64)
        order = np.lexsort((np.repeat(groups_of, sizes), doc, around, anchor))
        new_anchor = np.ones(len(order), dtype=bool)
        new_anchor[1:] = anchor[order][1:] != anchor[order][:-1]
        new_class = new_anchor.copy()
        new_class[1:] |= around[order][1:] != around[order][:-1]
        class_of = np.cumsum(new_class) - 1
        anchor_of = np.cumsum(new_anchor) - 1
        several = np.bincount(anchor_of[new_class], minlength=anchor_of[-1] + 1)[anchor_of] > 1
        least, asked = np.empty(len(order), np.int64), np.empty(len(order), bool)
        least[order] = doc[order][new_class][class_of]
        asked[order] = new_class & several
        bounds = np.cumsum([0, *sizes])
        out = [(g, 1, key[0].as_py(), _planes(least[i:j]) + np.packbits(asked[i:j]).tobytes()) for g, i, j in zip(groups_of, bounds, bounds[1:], strict=False)]
        return _sent(out, "g kind bucket value", told_kinds)

    def merged_windows(key, table):
        values = table["value"].to_pylist()
        sizes = [len(v) // (10 + REGION) for v in values]
        keys = np.concatenate([_numbers(v[: 8 * n], np.int64) for v, n in zip(values, sizes, strict=True)])
        ends = np.concatenate([np.frombuffer(v[8 * n : 10 * n], np.uint16) for v, n in zip(values, sizes, strict=True)]).astype(np.int64)
        content = np.concatenate([np.frombuffer(v[10 * n :], np.uint8).reshape(n, REGION) for v, n in zip(values, sizes, strict=True)])
        masks = repeated_windows(content, ends // 64, ends % 64, keys).astype("<u4")
        bounds = np.cumsum([0, *sizes])
        out = [(g, 2, key[0].as_py(), masks[i:j].tobytes()) for g, i, j in zip(table["g"].to_pylist(), bounds, bounds[1:], strict=False)]
        return _sent(out, "g kind bucket value", told_kinds)

    def final(key, left, right):
        return Group(left, right, buckets).result(whole_characters)

    again = by_group.applyInArrow(first, to_bucket).groupBy("bucket").applyInArrow(which_again, to_group)
    least = by_group.cogroup(again.groupBy("g")).applyInArrow(sending("class_hashes"), to_bucket).groupBy("bucket").applyInArrow(least_of_class, to_group)
    told = again.unionByName(least)
    windows = by_group.cogroup(told.groupBy("g")).applyInArrow(sending("surroundings"), to_bucket).groupBy("bucket").applyInArrow(merged_windows, to_group)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, remaining binary" + carried_schema
    return renamed(by_group.cogroup(told.unionByName(windows).groupBy("g")).applyInArrow(final, schema), keep)
