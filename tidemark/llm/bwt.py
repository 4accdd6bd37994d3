"""Burrows-Wheeler transforms of sets of short strings, merged by iterative interleave refinement.

A shard is a set of strings whose suffixes are sorted once, within the shard. Merging never compares suffixes again: an
interleave says which shard each place of the merged order belongs to, and one refinement step (a stable sort of the
transforms' symbols in interleave order) turns the order by h symbols into the order by h + 1. Places where the order by
h symbols first tells neighbours apart give their common prefix, and what is still one block after h steps is an
interval of suffixes that share h symbols.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a shard whose suffixes are sorted at once.
SHARD_SYMBOLS = 1 << 16


class Strings:
    """Strings of 16-bit symbols (1 and up), joined, each with a final 0."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        n = len(lengths)
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.owner = np.repeat(np.arange(n), self.lengths + 1)
        self.offset = np.arange(len(self.owner)) - self.starts[self.owner]
        self.text = np.zeros(len(self.owner), dtype=np.uint16)
        self.text[self.offset < self.lengths[self.owner]] = symbols
        self.longest = int(self.lengths.max(initial=0)) + 1


def suffix_order(strings: Strings, begin: int, end: int) -> np.ndarray:
    """The places of the joined text from ``begin`` to ``end``, in order of their suffixes; equal ones in order of place."""
    width = strings.longest
    text = np.zeros(end - begin + width, dtype=">u2")
    text[: end - begin] = strings.text[begin:end]
    left = strings.lengths[strings.owner[begin:end]] - strings.offset[begin:end]
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[: end - begin].copy()
    rows[np.arange(width)[None, :] > left[:, None]] = 0
    return begin + np.argsort(rows.view(f"S{2 * width}").ravel(), kind="stable")


def merge_transforms(strings: Strings, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all suffixes by their first ``steps`` symbols: places and common prefixes.

    ``common[i]`` is the number of symbols, up to ``steps``, that the suffixes i - 1 and i of the order share; suffixes
    that end alike share all. So ``common`` is below ``steps`` where a new interval of repeated strings starts.
    """
    total, count = len(strings.text), len(strings.lengths)
    shards, begin, last = [], 0, 0
    for stop in [*(strings.starts[1:].tolist()), total]:  # whole strings only
        if stop - begin > SHARD_SYMBOLS and last > begin:
            shards.append((begin, last))
            begin = last
        last = stop
    shards.append((begin, total))
    orders = [suffix_order(strings, a, b) for a, b in shards]
    order = np.concatenate(orders)
    before = strings.text[order - 1]
    before[strings.offset[order] == 0] = 0  # what stands before a string's start is an end
    shard_of = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), [len(o) for o in orders])
    ends = np.repeat(np.arange(len(shards), dtype=shard_of.dtype), [int((strings.text[a:b] == 0).sum()) for a, b in shards])

    interleave, block = shard_of, np.zeros(total, dtype=np.int32)
    common = np.full(total, steps, dtype=np.int32)
    common[0] = 0
    symbols = np.empty(total, dtype=np.uint16)
    fresh = np.empty(total, dtype=bool)
    for h in range(steps):
        symbols[np.argsort(interleave, kind="stable")] = before
        moved = np.argsort(symbols, kind="stable")[count:]  # the suffixes that are an end alone keep their places
        interleave = np.concatenate([ends, interleave[moved]])
        symbol, old = symbols[moved], block[moved]
        fresh[: count + 1] = False
        fresh[count : count + 1] = True
        fresh[count + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        common[fresh & (common == steps)] = h
        block = np.cumsum(fresh, dtype=np.int32)
    places = np.empty(total, dtype=np.int64)
    places[np.argsort(interleave, kind="stable")] = order
    return places, common
