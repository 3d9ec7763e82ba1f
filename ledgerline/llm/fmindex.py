"""FM-index over the words of a shard of texts: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 0 below 2**31 whose last one, and only that, is 0; by prefix doubling over unresolved suffixes only."""
    n = len(t)
    pad = np.concatenate([t, [0, 0]]).astype(np.int64)
    if n and int(t.max()) < 1 << 21:
        h, key = 3, (pad[:-2] << 42) | (pad[1:-1] << 21) | pad[2:]
    else:
        h, key = 2, (pad[:-2] << 31) | pad[1:-1]
    sa = np.argsort(key)
    got = key[sa]
    first = np.concatenate([[True], got[1:] != got[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa] = start
    rank[n] = -1
    open_ = ~(first & np.concatenate([first[1:], [True]]))
    slots = np.flatnonzero(open_)
    while len(slots):
        members = sa[slots]
        key = (rank[members] << 32) + rank[np.minimum(members + h, n)] + 1
        order = np.argsort(key)
        members, key = members[order], key[order]
        sa[slots] = members
        first = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.maximum.accumulate(np.where(first, slots, 0))
        rank[members] = heads
        slots = slots[~(first & np.concatenate([first[1:], [True]]))]
        h *= 2
    return sa


class Bits:
    """A bit vector with rank in two reads."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        self.words = np.packbits(np.concatenate([bits, np.zeros(64 - self.n % 64, bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)


class Wavelet:
    """Wavelet matrix: the wavelet tree's levels as one bit vector each, zeros moved before ones."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for k in range(self.depth - 1, -1, -1):
            bit = (s >> k) & 1 == 1
            self.levels.append(Bits(bit))
            low = s[~bit]
            self.zeros.append(len(low))
            s = np.concatenate([low, s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i."""
        start = np.zeros_like(i)
        for k, bits, z in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros):
            one = (c >> k) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, z + a, start - a), np.where(one, z + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and its occurrences before i."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bits, z in zip(self.levels, self.zeros):
            one = bits.get(i)
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, z + a, start - a), np.where(one, z + b, i - b)
            c = (c << 1) | one
        return c, i - start


class FMIndex:
    """Of symbols >= 1 below sigma (0 is added as the end)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        t = np.concatenate([symbols, [0]]).astype(np.int64)
        sa = suffix_order(t)
        self.n = len(t)
        self.bwt = Wavelet(t[sa - 1].astype(np.int32), sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        kept = sa % sample == 0
        self.kept, self.at = Bits(kept), sa[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that begin with each pattern (rows of a matrix), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64)
            lo, hi = self.less[c] + self.bwt.rank(c, lo), self.less[c] + self.bwt.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to a sampled one in fewer than ``sample`` steps."""
        out, steps, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            hit = self.kept.get(at)
            out[todo[hit]] = self.at[self.kept.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            c, r = self.bwt.access(at)
            at = self.less[c] + r
            steps += 1
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence."""
        lo, hi = self.ranges(patterns)
        n = hi - lo
        which = np.repeat(np.arange(len(patterns)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return which, self.locate(rows)
