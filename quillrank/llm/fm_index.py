"""FM-index of an integer text: wavelet-tree ranks over the Burrows-Wheeler
transform, backward search of many patterns at once, and location of their
occurrences from sampled suffix positions."""

from __future__ import annotations

import numpy as np

from quillrank.llm.wavelet import Bits, WaveletMatrix

#: Every so many-th text position keeps its place in the suffix order.
SAMPLE_EVERY = 16
#: Rows walked to their positions at a time.
LOCATE_ROWS = 1 << 20


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order (prefix doubling; a suffix that ends sorts first)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n > 1:
        then = np.zeros(n, np.int64)
        if width < n:
            then[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + then
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1 or width >= 2 * n:
            break
    return order


class FMIndex:
    """Index of a text of symbols 0..size-1; patterns must not be empty."""

    def __init__(self, text: np.ndarray, size: int):
        end = np.concatenate([np.asarray(text, np.int64) + 1, [0]])  # 0 ends the text
        self.n, self.symbols = len(end), size + 1
        order = suffix_order(end)
        self.bwt = WaveletMatrix.of(end[order - 1], max(1, int(self.symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=self.symbols))])
        marked = (order % SAMPLE_EVERY == 0) | (order == self.n - 1)
        self.marked, self.samples = Bits.of(marked), order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns (one a row), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for symbol in np.asarray(patterns, np.int64).T[::-1]:
            s = symbol[alive] + 1
            both = self.bwt.rank(np.concatenate([s, s]), np.concatenate([lo[alive], hi[alive]]))
            lo[alive], hi[alive] = self.before[s] + both[: len(s)], self.before[s] + both[len(s) :]
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled row."""
        out = np.empty(len(rows), np.int64)
        for start in range(0, len(rows), LOCATE_ROWS):
            row = np.asarray(rows[start : start + LOCATE_ROWS], np.int64).copy()
            todo, steps = np.arange(len(row)), 0
            while len(todo):
                found = self.marked.get(row[todo]) == 1
                done = todo[found]
                out[start + done] = (self.samples[self.marked.rank1(row[done])] + steps) % self.n
                todo = todo[~found]
                if len(todo):
                    symbol = self.bwt.access(row[todo])
                    row[todo] = self.before[symbol] + self.bwt.rank(symbol, row[todo])
                    steps += 1
        return out
