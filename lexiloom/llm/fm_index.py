"""An FM-index over integer sequences: suffix array by prefix doubling, wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``seq``, whose last value must be its only 0."""
    n = len(seq)
    place, width = max(1, n.bit_length()), max(1, int(seq.max(initial=0)).bit_length())
    span = max(1, (63 - place) // width)
    key = np.zeros(n, dtype=np.int64)
    for k in range(span):
        key <<= width
        if k < n:
            key[: n - k] |= seq[k:]
    mask = (1 << place) - 1
    key = np.sort((key << place) | np.arange(n))
    order = key & mask
    key >>= place
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while not new.all():
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)  # only suffixes that tie with another one are sorted again
        who = order[at]
        ahead = who + span
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[who]
        by = np.lexsort((second, group))
        who, second, group = who[by], second[by], group[by]
        order[at] = who
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (second[1:] != second[:-1]) | (group[1:] != group[:-1])
        new[at] = fresh
        rank[who] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        span *= 2
    return order


class WaveletMatrix:
    """Rank and access of a sequence with small values, one bit plane a level."""

    def __init__(self, seq: np.ndarray):
        self.levels = max(1, int(seq.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            up = bit.astype(bool)
            seq = np.concatenate([seq[~up], seq[up]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before position ``at``."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((value >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[at], ones[low]
            at, low = np.where(up, zeros + a, at - a), np.where(up, zeros + b, low - b)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the positions, and how often each occurs before."""
        value, low = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b = ones[at], ones[low]
            up = ones[at + 1] > a
            value = (value << 1) | up
            at, low = np.where(up, zeros + a, at - a), np.where(up, zeros + b, low - b)
        return value, at - low


class FmIndex:
    """Counts and locates patterns in ``seq`` (values of 1 or more; a 0 is put at its end)."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        order = suffix_array(seq)
        self.wavelet = WaveletMatrix(seq[order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        marked = order % sample == 0
        self.marked, self.sampled = np.concatenate([[0], np.cumsum(marked)]), order[marked]
        self.size = len(seq)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns, one a row, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            known = c >> self.wavelet.levels == 0
            lo[alive[~known]] = hi[alive[~known]] = 0
            alive, c = alive[known], c[known]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        out, rows, left, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(left):
            there = self.marked[rows + 1] > self.marked[rows]
            out[left[there]] = self.sampled[self.marked[rows[there]]] + steps
            left, rows = left[~there], rows[~there]
            value, rank = self.wavelet.access(rows)
            rows, steps = self.before[value] + rank, steps + 1
        return out
