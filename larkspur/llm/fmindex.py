"""FM-index over a shard's token stream: suffix sort, wavelet-matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; text holds integers, its last one smaller than all others."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * np.int64(n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        """text: integers in [1, alphabet); 0 is appended as the end."""
        text = np.concatenate((text, [0])).astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = text[sa - 1]
        counts = np.bincount(text, minlength=alphabet)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        sampled = sa % SAMPLE == 0
        self.marked = sampled
        self.mark_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = sa[sampled]
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first `at` symbols of the transform."""
        base = np.zeros_like(at)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            ones = self.ones[k]
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
            base = np.where(one, self.zeros[k] + ones[base], base - ones[base])
        return at - base

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each pattern; patterns are rows padded on the right."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for step in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((length >= step) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, length[live] - step]
            lo[live] = self.before[symbol] + self.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix, at most SAMPLE - 1 steps."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.before[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.marked[rows[live]]]
        return self.samples[self.mark_rank[rows]] + steps
