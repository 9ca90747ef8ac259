"""Vectorised words of Arrow text columns: whole texts as byte arrays, words as (start, end, document) arrays.

Bytes stand for code points: every separator used here is ASCII, so UTF-8 words have the same borders either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240517)
#: A random 64-bit value per byte, with A-Z like a-z.
_LETTER = _RNG.integers(0, 2**64, 256, dtype=U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER_LOWER = _LETTER[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but digits and letters.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, dtype=U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), 2**64))])
    return out[:n]


class _Powers:
    up = powers(_BASE, 1 << 16)
    down = powers(_INVERSE, 1 << 16)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            cls.up, cls.down = powers(_BASE, size), powers(_INVERSE, size)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is several times faster here than ``np.unique``, that hashes."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as non-null large strings."""
    a = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(a.cast(pa.large_string()), "")


def blocks(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in pieces of about ``most`` bytes; a longer text is a piece of its own."""
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each document's first word number (length: documents + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; equal words are equal in any block."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    up, down = _Powers.get(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=U64)
    total[0] = 0
    np.cumsum((_LETTER_LOWER if lower else _LETTER)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's words, given the documents' first word numbers."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
