"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its own input split, so nothing is shuffled and a lost task is simply run again. Whole
windows are cut off a document first; the rest goes to the fill level that leaves the smallest sum of squared counts
of partially filled windows. A level array holds those counts. What is still open at the end of a task is closed by the
same rule: the content of the emptiest window is one more piece, which may be cut, and goes where the sum of squares
becomes smallest; the last window is cut into windows of power-of-two lengths, so nothing is padded. A task holds no
more than ``OPEN_WINDOWS`` open windows; beyond that it closes one in the same way and packs on.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Most windows that a task holds open, some 32 MB of ids; beyond that one is closed by the rule itself.
OPEN_WINDOWS = 4096
#: Tokens that may follow a document's ids.
END_OF_DOCUMENT = 1


class TokenEncoder:
    """Ids of a byte-level BPE tokenizer file (JSON of the ``tokenizers`` library) through the ``tiktoken`` encoder.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``, special strings in a text included, several times as fast.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken

        model = json.loads(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")


class SumOfSquares:
    """Online packing of one task's documents into windows of ``size`` tokens."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next_sequence = size, first_sequence
        self.rows: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.counts = np.zeros(self.size + 1, dtype=np.int64)  # windows at each fill level
        self.windows: list[list[list[tuple]]] = [[] for _ in range(self.size + 1)]
        self.open = 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, at))
            at += len(ids)
        self.next_sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self._close([(doc, start, ids[start : start + self.size], len(ids))])
        if len(ids) > whole:
            self._place((doc, whole, ids[whole:].copy(), len(ids)))

    def _place(self, piece: tuple) -> None:
        level = self.best_level(len(piece[2]))
        self._put(level, [piece], len(piece[2]))
        while self.open > OPEN_WINDOWS:
            self.close_one()

    def best_level(self, n: int, cut: bool = False) -> int:
        """The level (0: an empty window) of the window that ``n`` tokens go to for the least sum of squared counts.

        A window that becomes full leaves the counts. With ``cut`` the tokens may be cut to fill a window, and what is
        left makes one at its own level; an empty window is then no choice. Of equal ones, the fullest window.
        """
        counts, size = self.counts, self.size
        levels = np.flatnonzero(counts)
        levels = levels if cut else levels[levels <= size - n]
        if not len(levels):
            return 0
        total = levels + n
        # One window fewer at its level, and one more at the new level, unless that is 0 or full.
        change = 1 - 2 * counts[levels]
        after = np.where(total > size, total - size, total)
        grows = (total != size) & (after > 0)
        gain = 2 * counts[after] + 1
        gain -= 2 * (after == levels)  # the window leaves that level before the other one comes
        change = change + np.where(grows, gain, 0)
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if cut or change[best] <= 2 * int(counts[n]) + 1 else 0

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _put(self, level: int, pieces: list[tuple], n: int) -> None:
        """Adds ``n`` tokens to a window at ``level``, or to an empty one; they must fit."""
        whole = (self._take(level) if level else []) + pieces
        if level + n == self.size:
            self._close(whole)
            return
        self.windows[level + n].append(whole)
        self.counts[level + n] += 1
        self.open += 1

    def close_one(self) -> None:
        """The content of the emptiest window goes, cut if need be, to the window that the rule chooses; then one fewer is open."""
        donor = int(np.flatnonzero(self.counts)[0])
        pieces = self._take(donor)
        level = self.best_level(donor, cut=True)
        room = self.size - level
        if donor <= room:
            self._put(level, pieces, donor)
            return
        head, tail = split_pieces(pieces, room)
        self._put(level, head, room)
        self._put(0, tail, donor - room)

    def finish(self) -> None:
        """Closes all open windows; the last one is cut into windows of power-of-two lengths."""
        while self.open > 1:
            self.close_one()
        if self.open:
            left = int(np.flatnonzero(self.counts)[0])
            pieces = self._take(left)
            for b in range(62, -1, -1):
                if left >> b & 1:
                    head, pieces = split_pieces(pieces, 1 << b)
                    self._close(head)


def split_pieces(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``n`` tokens of pieces, and the rest."""
    head, tail = [], []
    for doc, start, ids, total in pieces:
        k = min(n, len(ids))
        n -= k
        if k:
            head.append((doc, start, ids[:k], total))
        if k < len(ids):
            tail.append((doc, start + k, ids[k:], total))
    return head, tail


def pack_documents(docs: DataFrame, tokenizer_json: str, pattern: str, size: int = 2048) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_json`` is the content of the tokenizer file (a bounded file, sent with the task). A null or empty text
    is its end id alone. Null, equal and repeated ids are packed row by row; an empty table gives no piece; other
    columns are left out. Texts are tokenised whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = TokenEncoder(spec.value[0], spec.value[1])
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 40)
        end = np.array([END_OF_DOCUMENT], dtype=np.uint32)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in small_batches(batches, "text", 8 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.concatenate([encoder.ids(text or ""), end]))
            yield rows()
        packer.finish()
        yield rows()

    spec = docs.sparkSession.sparkContext.broadcast((tokenizer_json, pattern))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
