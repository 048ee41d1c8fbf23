"""Histogram gradient-boosted trees for two classes, in numpy.

Training works on a bounded matrix in memory.  The fitted model is a handful of
flat arrays (feature, threshold, children, value of every node of every tree),
which a task walks for all its rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """Trees of equal depth, laid out level by level: children of node i are 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray     # (trees, inner nodes); -1: always left
    threshold: np.ndarray   # (trees, inner nodes); go right if value > threshold
    value: np.ndarray       # (trees, 2^depth leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                right = (f[node] >= 0) & (x[rows, f[node]] > t[node])
                node = 2 * node + 1 + right
            out += v[node - (2 ** self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def constant(p: float) -> Model:
    """Model that gives every row the score ``p``."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(float(np.log(p / (1 - p))), 1, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, l2: float = 1.0, least_hessian: float = 1.0) -> Model:
    """Boost logistic loss.  ``x`` is (rows, features) without NaN, ``y`` holds 0.0 to 1.0."""
    if not len(y):
        return constant(0.5)
    p = float(y.mean())
    if p in (0.0, 1.0):
        return constant(p)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    model = constant(p)
    margin = np.full(n, model.base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    fs, ts, vs = [], [], []
    for _ in range(trees):
        q = 1.0 / (1.0 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        f, t = np.full(inner, -1, np.int64), np.zeros(inner)
        for level in range(depth):
            width = 2 ** level
            at = node - (width - 1)
            gain, split = np.zeros(width), np.full((width, 2), -1, np.int64)
            for j in range(m):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                cell = at * k + binned[:, j]
                gl = np.cumsum(np.bincount(cell, g, width * k).reshape(width, k), axis=1)
                hl = np.cumsum(np.bincount(cell, h, width * k).reshape(width, k), axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                won = gl ** 2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga ** 2 / (ha + l2)
                won[(hl < least_hessian) | (ha - hl < least_hessian)] = 0
                best = won.argmax(axis=1)
                top = won[np.arange(width), best]
                new = top > gain + 1e-9
                gain[new] = top[new]
                split[new] = np.stack([np.full(width, j), best], axis=1)[new]
            right = np.zeros(n, bool)
            for i in range(width):
                j, b = split[i]
                if j >= 0:
                    f[width - 1 + i], t[width - 1 + i] = j, edges[j][b]
                    mine = at == i
                    right[mine] = binned[mine, j] > b
            node = 2 * node + 1 + right
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += v[leaf]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Model(model.base, depth, np.stack(fs), np.stack(ts), np.stack(vs))
