"""Union-find over integer positions, many unions at a time."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray | None = None) -> np.ndarray:
        """Smallest position known to be connected with each of ``i`` (default: all)."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent if i is None else self.parent[i]
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
