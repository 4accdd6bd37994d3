"""Hashed character n-grams of whole texts, worked out for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII characters other than letters become spaces; bytes of other characters stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-cased UTF-8 bytes with a space on either side; ASCII characters that are no letters become one space."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def hashed_ngrams(texts: list[bytes], sizes: range, bits: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Where each text starts in all of them joined (and the end), and for each size n the hash of the n bytes from each place.

    Hashes have ``bits`` bits; 0 stands for a run that would leave its text.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    starts = np.cumsum([0] + [len(t) for t in texts])

    def hashes() -> Iterator[np.ndarray]:
        rolled = np.zeros(len(data), dtype=np.uint32)
        for n in range(1, sizes.stop):
            if len(data) < n:
                return
            rolled = rolled[: len(data) - n + 1] * np.uint32(0x01000193)
            rolled += data[n - 1 :]
            rolled += np.uint32(1)
            if n >= sizes.start:
                mixed = rolled ^ (rolled >> np.uint32(15))
                mixed *= np.uint32(0x9E3779B1)
                mixed >>= np.uint32(32 - bits)
                leaving = (starts[1:, None] - np.arange(1, n)).ravel()
                mixed[leaving[(leaving >= 0) & (leaving < len(mixed))]] = 0
                yield mixed.view(np.int32)

    return starts, hashes()
