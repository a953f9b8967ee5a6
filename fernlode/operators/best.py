"""The best of what a task has seen, for many queries at once."""

from __future__ import annotations

import numpy as np

#: Rows that wait, at least, until they are cut to the best ones.
WAITING = 1 << 18


class Best:
    """The k rows of each query, given by its number, with the highest values; ties go to the lower id.

    `floor` has the value that a row of a query must have. ascending: rows come in the order of their ids, so that one
    equal to the k-th best comes too late.
    """

    def __init__(self, queries: int, k: int, least: float = -np.inf, ascending: bool = False) -> None:
        self.k, self.ascending = k, ascending
        self.floor, self.full = np.full(queries, least), np.zeros(queries, bool)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(WAITING, 2 * queries * k)

    def add(self, q: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor[q]
        keep = value >= floor
        if self.ascending:
            keep &= (value > floor) | ~self.full[q]
        if keep.any():
            self.rows.append((q[keep], value[keep], ids[keep]))
            self.waiting += int(keep.sum())
            if self.waiting > self.most:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, value, id) of the best so far."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, value, ids = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -value, q))
        q, value, ids = q[order], value[order], ids[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.floor[q[last]], self.full[q[last]] = value[last], True
        keep = nth < self.k
        self.rows, self.waiting = [(q[keep], value[keep], ids[keep])], 0
        return self.rows[0]
