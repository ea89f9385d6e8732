"""Sparse matrices by rows, and their product row by row after Gustavson."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class CSR(NamedTuple):
    """Row ``i`` has the columns ``indices[indptr[i]:indptr[i + 1]]`` with ``values``; without values each is 1."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.indptr)

    def row_of(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.rows), self.sizes())


def spans(ends: np.ndarray) -> CSR:
    """Incidence of neighbouring spans with what they cover: span ``i`` covers ``[ends[i - 1], ends[i])``."""
    indptr = np.concatenate([[0], ends]).astype(np.int64)
    return CSR(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def members(group: np.ndarray, groups: int) -> CSR:
    """Incidence of items with the one group that each is in."""
    return CSR(np.arange(len(group) + 1), group, groups)


def transpose(m: CSR) -> CSR:
    """Counting sort by column."""
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    order = np.argsort(m.indices, kind="stable")
    values = None if m.values is None else m.values[order]
    return CSR(indptr, m.row_of()[order], m.rows, values)


def row_work(a: CSR, b: CSR) -> np.ndarray:
    """Terms that each row of ``a · b`` sums up, before any is formed (the symbolic step)."""
    terms = np.concatenate([[0], np.cumsum(b.sizes()[a.indices])])
    return terms[a.indptr[1:]] - terms[a.indptr[:-1]]


def product_blocks(a: CSR, b: CSR, terms: int = 1 << 20) -> Iterator[tuple[int, CSR]]:
    """``a · b`` in blocks of rows, each with the number of its first row.

    A row of the product is the sum of the rows of ``b`` that the row of ``a`` names. Rows are taken together until they
    have ``terms`` terms, so memory is bounded by that, or by one row. Both matrices have ones only; a value counts
    the terms that fell together.
    """
    work = np.concatenate([[0], np.cumsum(row_work(a, b))])
    sizes, low = b.sizes(), 0
    while low < a.rows:
        high = max(low + 1, int(np.searchsorted(work, work[low] + terms, side="right")) - 1)
        named = a.indices[a.indptr[low] : a.indptr[high]]
        row = np.repeat(np.arange(high - low), np.diff(a.indptr[low : high + 1]))
        n = sizes[named]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(b.indptr[named] - (ends - n), n)
        cell = np.repeat(row, n) * b.columns + b.indices[at]
        if np.any(cell[1:] < cell[:-1]):
            cell.sort()
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[:total])
        cells = cell[first]
        indptr = np.searchsorted(cells, np.arange(high - low + 1) * b.columns)
        yield low, CSR(indptr, cells % b.columns, b.columns, np.diff(np.append(first, total)))
        low = high


def product(a: CSR, b: CSR, terms: int = 1 << 20) -> CSR:
    parts = [p for _, p in product_blocks(a, b, terms)]
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return CSR(np.zeros(a.rows + 1, dtype=np.int64), none, b.columns, none)
    sizes = np.concatenate([p.sizes() for p in parts])
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    return CSR(indptr, np.concatenate([p.indices for p in parts]), b.columns, np.concatenate([p.values for p in parts]))
