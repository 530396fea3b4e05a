"""Groups of linked rows inside one task."""

from __future__ import annotations

import numpy as np


class Groups:
    """Which rows are linked, directly or not: every row knows the smallest row of its group."""

    def __init__(self, rows: int):
        self.least = np.arange(rows)
        self._changes: np.ndarray | None = None

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.least[a], self.least[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            self._changes = None
            np.minimum.at(self.least, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.least[self.least]
                if (further == self.least).all():
                    break
                self.least = further

    def one(self, la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """Whether the ranges [la, ha) and [lb, hb) lie in one group together."""
        if self._changes is None:
            self._changes = np.concatenate([[0], np.cumsum(self.least[1:] != self.least[:-1])])
        c = self._changes
        return (c[ha - 1] == c[la]) & (c[hb - 1] == c[lb]) & (self.least[la] == self.least[lb])
