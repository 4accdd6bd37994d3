"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves a whole pre-token that is in the vocabulary through a minimal perfect hash and one comparison. Tier
two merges the bytes of any other pre-token: a doubly linked list of parts and a heap of mergeable neighbours by rank.
A bounded memo holds the ids of pre-tokens already met in a worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of pre-tokens and ids, and of what Python needs to hold each, that a worker remembers at most.
MEMO_BYTES, ENTRY_BYTES = 200_000_000, 200


def parse_ranks(content: bytes) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file in order of rank."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in content.splitlines() if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0 without gaps")
    return [token for _, token in pairs]


class PerfectHash:
    """A minimal perfect hash of distinct byte strings by displacement: slots 0 to n - 1, one for each key."""

    def __init__(self, keys: list[bytes]):
        from xxhash import xxh3_64_intdigest as digest

        n = len(keys)
        self.n, self.digest = n, digest
        self.buckets = max(1, n // 2)
        self.shift = [(0, 0)] * self.buckets
        self.slot_of = [0] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        places = []
        for i, key in enumerate(keys):
            h = digest(key)
            members[(h >> 40) % self.buckets].append(i)
            places.append((h % n, 1 + (h >> 20) % max(1, n - 1)))
        taken = bytearray(n)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                a, c, slots = self._displacement([places[i] for i in own], taken)
                self.shift[b] = (a, c)
            elif own:  # a lone key takes any free slot: the shift names it
                free = free or (i for i in range(n) if not taken[i])
                slots = [next(free)]
                self.shift[b] = (-1, slots[0])
            for i, slot in zip(own, slots if own else (), strict=True):
                self.slot_of[i], taken[slot] = slot, 1

    def _displacement(self, places: list[tuple[int, int]], taken: bytearray) -> tuple[int, int, list[int]]:
        """The first shift that sends the keys of a bucket to different free slots."""
        n = self.n
        for c in range(n):
            for a in range(64):
                slots = [(low + high * a + c) % n for low, high in places]
                if not any(taken[s] for s in slots) and len({*slots}) == len(slots):
                    return a, c, slots
        raise ValueError("two keys have the same hash")

    def slot(self, key: bytes) -> int:
        h = self.digest(key)
        a, b = self.shift[(h >> 40) % self.buckets]
        return b if a < 0 else (h % self.n + (1 + (h >> 20) % max(1, self.n - 1)) * a + b) % self.n


class Memo(dict):
    """Ids of pre-tokens, worked out when first asked for."""

    def __init__(self, work_out):
        self.work_out, self.held = work_out, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.work_out(text)
        size = ENTRY_BYTES + 4 * len(text) + len(ids)
        if self.held + size <= MEMO_BYTES:
            self[text] = ids
            self.held += size
        return ids

    def shrink(self) -> None:
        """Once it is nearly full, keeps the first half: frequent pre-tokens are met early."""
        if self.held > 0.9 * MEMO_BYTES:
            kept = list(islice(self.items(), len(self) // 2))
            self.clear()
            self.update(kept)
            self.held = sum(ENTRY_BYTES + 4 * len(text) + len(ids) for text, ids in kept)


class Vocabulary:
    """Tokens by rank, with the two tiers of encoding and the decoding of ids."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.hash = PerfectHash(tokens)
        self.at: list[tuple[bytes, int]] = [(b"", -1)] * len(tokens)
        for i, token in enumerate(tokens):
            self.at[self.hash.slot_of[i]] = (token, i)
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.memo = Memo(self.encode_piece)

    def whole(self, piece: bytes) -> int:
        """The id of a piece in the vocabulary, else -1."""
        if len(piece) > self.longest:
            return -1
        token, i = self.at[self.hash.slot(piece)]
        return i if token == piece else -1

    def merged(self, piece: bytes) -> bytes:
        """The packed ids of any piece: always the leftmost mergeable neighbours of the lowest rank become one part."""
        n, rank = len(piece), self.ranks.get
        bits = n.bit_length()
        low = (1 << bits) - 1
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        # An entry holds rank, first byte and end of a possible part, so that entries compare as integers.
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            left, end = entry >> bits & low, entry & low
            if ends[left] < 0 or (right := after[left]) >= n or ends[right] != end:
                continue  # one of the two parts has changed since
            ends[right] = -1
            ends[left] = end
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (r := rank(piece[left : ends[nxt]])) is not None:
                    heappush(heap, (r << bits | left) << bits | ends[nxt])
            if (prev := before[left]) >= 0 and (r := rank(piece[prev:end])) is not None:
                heappush(heap, (r << bits | prev) << bits | end)
        packed, ranks = self.packed, self.ranks
        return b"".join([packed[ranks[piece[i:end]]] for i, end in enumerate(ends) if end > 0])

    def encode_piece(self, text: str) -> bytes:
        piece = text.encode("utf-8", "surrogatepass")
        i = self.whole(piece)
        return self.packed[i] if i >= 0 else self.merged(piece)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids = b"".join(map(self.memo.__getitem__, self.find(text)))
        self.memo.shrink()
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(content: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a file's content, built once in each worker."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(parse_ranks(content), pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with ``with_ids`` also the ids and the decoded text.

    ``ranks`` is the content of a ``.tiktoken`` file (bounded, sent with the task). A null or empty text has no tokens.
    Repeated and null doc_ids give a row each; an empty table gives none; other columns are left out. No special
    tokens are looked for.
    """
    schema = ENCODED + (", ids array<int>, decoded string" if with_ids else "")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(*shared.value)
        for batch in small_batches(batches, "text", 8 << 20):
            out = []
            for text in batch.column(1).to_pylist():
                ids = vocab.encode(text or "")
                decoded = vocab.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append((*row, np.frombuffer(ids, dtype="<u4").tolist(), decoded.decode()) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
