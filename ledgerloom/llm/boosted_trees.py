"""Gradient-boosted trees for binary labels in numpy: logistic loss, histograms of quantile bins, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # tree x inner node, level by level
    threshold: np.ndarray
    value: np.ndarray  # tree x leaf
    start: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.start)
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (flat[base + f[node]] > t[node])
            z += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 32, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 1.0) -> Trees:
    """Fit on rows x, labels y (0 or 1) and weights. The same rows give the same trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))), depth)
    z = np.full(len(x), out.start)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * (len(e) + 1) + binned[:, f]
                gs = np.bincount(at, g, count * (len(e) + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(at, h, count * (len(e) + 1)).reshape(count, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for i in np.flatnonzero(top > best):
                    best[i], out.feature[tree, first + i], out.threshold[tree, first + i] = top[i], f, e[k[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), out.feature[tree, node]] > out.threshold[tree, node])
        leaf = node - (2**depth - 1)
        out.value[tree] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        z += out.value[tree][leaf]
    return out
