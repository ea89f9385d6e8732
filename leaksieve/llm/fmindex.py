"""FM-index over a sequence of word numbers: wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; every 0 is a separator with an order of its own, so no comparison crosses one."""
    n = len(text)
    breaks = text == 0
    rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + int(breaks.sum()))
    width = 1
    while True:
        following = np.full(n, -1, dtype=np.int64)
        following[: n - width] = rank[width:] if width < n else rank[:0]
        key = rank * (rank.max() + 2) + following + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = fresh
        if rank.max() == n - 1:
            return order
        width *= 2


class FMIndex:
    """``text``: numbers from 1, with 0 as separator; it must begin and end with one.

    ``sample``: the distance of sampled positions. Starts of runs are sampled too, so the walk to a
    sampled position never crosses a separator.
    """

    def __init__(self, text: np.ndarray, sample: int = 8):
        order = suffix_array(text)
        before = text[order - 1]  # the separators at both ends make the wrap harmless
        self.n = len(text)
        self.levels: list[tuple[np.ndarray, int]] = []
        symbols = before
        for level in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = ((symbols >> level) & 1).astype(bool)
            counts = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((counts, self.n - int(counts[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        size = int(text.max()) + 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.base = self._descend(np.arange(size), np.zeros(size, dtype=np.int64))
        kept = (order % sample == 0) | (before == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def _descend(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        depth = len(self.levels)
        for k, (counts, zeros) in enumerate(self.levels):
            one = (symbols >> (depth - 1 - k)) & 1
            ones = counts[rows]
            rows = np.where(one, zeros + ones, rows - ones)
        return rows

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """From rows to the rows after putting a symbol in front."""
        return self.start[symbols] + self._descend(symbols, rows) - self.base[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each pattern (patterns of one length, as a matrix)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        alive = np.flatnonzero((patterns < len(self.base)).all(axis=1))
        low[:], keep = 0, np.zeros(len(patterns), dtype=bool)
        keep[alive] = True
        high[~keep] = 0
        for column in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, column]
            low[alive] = self._step(symbols, low[alive])
            high[alive] = self._step(symbols, high[alive])
            alive = alive[high[alive] > low[alive]]
        found = np.zeros(len(patterns), dtype=bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walking back to the nearest sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.positions[self.kept_before[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbols = np.zeros(len(rows), dtype=np.int64)
            at = rows
            for counts, zeros in self.levels:
                ones = counts[at]
                one = counts[at + 1] - ones
                symbols = symbols * 2 + one
                at = np.where(one, zeros + ones, at - ones)
            rows = self.start[symbols] + at - self.base[symbols]
            steps += 1
        return out
