"""Words and character n-grams of many texts at once, as numpy arrays.

Texts of a batch lie one after the other in one buffer, and a word is its place in it, so that hashing, shingling and
scoring are array operations whose cost is that of the bytes read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, text_bytes

#: Bytes of text that are turned into words at once.
BATCH_BYTES = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Word characters: ASCII letters and digits, and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


class Words:
    """The words of texts: hash (64 bits), doc (row of the text), start and stop (bytes in `flat`), first (n + 1 rows)."""

    def __init__(self, texts: pa.Array):
        self.flat, self.offsets = text_bytes(lowered(texts))
        n = len(self.flat)
        inside = _WORD[self.flat]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        power, inverse = _tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix64((total[self.stop] - total[self.start]) * inverse[self.start] + (self.stop - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def grams(self, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the first word) of runs of n words of one text, or of n words each `skip` apart."""
        reach = (n - 1) * (skip + 1)
        m = len(self.hash) - reach
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[reach:])
        h = np.full(len(at), n * 31 + skip, np.uint64)
        for k in range(n):
            h = h * _BASE + self.hash[at + k * (skip + 1)]
        return mix64(h), at


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in lower case, n + 1 offsets)."""
    low = lowered(texts)
    n = np.asarray(pc.utf8_length(low), np.int64)
    flat = "".join(low.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.uint32), np.concatenate([[0], np.cumsum(n)])


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i] : first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
