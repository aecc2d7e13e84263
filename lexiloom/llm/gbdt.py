"""Histogram gradient-boosted trees in numpy, with trees flattened into arrays."""

from __future__ import annotations

import numpy as np


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Rising cut points of each column, at its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


class Trees:
    """A sum of complete trees of one depth. Node i has children 2i+1 (value <= cut) and 2i+2."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf = np.zeros((0, 2**depth), np.float32)

    def add(self, feature, cut, leaf) -> None:
        self.feature = np.vstack([self.feature, feature[None]])
        self.cut = np.vstack([self.cut, cut[None].astype(np.float32)])
        self.leaf = np.vstack([self.leaf, leaf[None].astype(np.float32)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, level by level."""
        x = x.astype(np.float32)
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int32)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss, second-order gains, one histogram per node and feature."""
    p0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(depth, float(np.log(p0 / (1 - p0))))
    if len(np.unique(y)) < 2:
        return model
    x = x.astype(np.float32).astype(np.float64)
    cuts = edges_of(x, bins)
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    score = np.full(len(y), model.base)
    n_f, width = x.shape[1], bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(count)
            for f in range(n_f):
                key = at * width + binned[:, f]
                gs = np.bincount(key, g, count * width).reshape(count, width)
                hs = np.bincount(key, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                b = gain.argmax(1)
                better = gain[np.arange(count), b] > best + 1e-9
                best[better] = gain[np.arange(count), b][better]
                feature[first : first + count][better] = f
                cut[first : first + count][better] = cuts[f][b[better]]
            right = x[np.arange(len(y)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        model.add(feature, cut, leaf)
        score += leaf[at]
    return model
