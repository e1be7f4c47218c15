"""Suffix arrays, wavelet matrices and an FM-index over integer sequences, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative integers that ends with 0. Each 0 is a separator of its own:
    separators compare by position and are below all else, so no comparison crosses one.

    Ranks are refined by doubling, and only suffixes that still tie are sorted again."""
    n = len(s)
    seps = s == 0
    k = int(seps.sum())
    key = s.astype(np.int64) + k
    key[seps] = np.arange(k)
    order = np.argsort(key, kind="stable")
    sk = key[order]
    start = np.flatnonzero(np.r_[True, sk[1:] != sk[:-1]])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    idx = order[np.repeat(size > 1, size)]
    step = 1
    while idx.size:
        both = rank[idx] * (n + 1) + rank[idx + step]
        o = np.argsort(both, kind="stable")
        idx, both = idx[o], both[o]
        group = both // (n + 1)
        pos = np.arange(len(idx))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_sub = np.r_[True, both[1:] != both[:-1]]
        gstart = np.maximum.accumulate(np.where(new_group, pos, 0))
        sstart = np.maximum.accumulate(np.where(new_sub, pos, 0))
        rank[idx] = group + sstart - gstart
        starts = np.flatnonzero(new_sub)
        sizes = np.diff(np.r_[starts, len(idx)])
        idx = idx[np.repeat(sizes > 1, sizes)]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class WaveletMatrix:
    """rank(c, i): how many of the first i symbols are c, for arrays of c and i at once."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            up = ((c >> level) & 1).astype(bool)
            one = self.ones[k]
            oi, ol = one[i], one[lo]
            i, lo = np.where(up, self.zeros[k] + oi, i - oi), np.where(up, self.zeros[k] + ol, lo - ol)
        return i - lo


class FMIndex:
    """Over a sequence of runs, each ended by 0. Patterns hold no 0."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = 16):
        sa = suffix_array(s)
        before = s[sa - 1]
        self.bwt = before
        self.wavelet = WaveletMatrix(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))]).astype(np.int64)
        # every sample-th position is kept, and every start of a run, so that no walk crosses a separator
        marked = (sa % sample == 0) | (before == 0)
        self.mark = np.full(len(s), -1, np.int64)
        self.mark[marked] = sa[marked]
        self.n = len(s)

    def step(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[c] + self.wavelet.rank(c, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, filled up with 0 on the left) at once: suffix-array intervals."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= j) & (lo[live] < hi[live])]
            if not live.size:
                break
            c = patterns[live, -j]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walked back to a sampled position."""
        out, steps, open_, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while open_.size:
            found = self.mark[row] >= 0
            out[open_[found]] = self.mark[row[found]] + steps
            open_, row = open_[~found], row[~found]
            row = self.step(self.bwt[row], row)
            steps += 1
        return out
