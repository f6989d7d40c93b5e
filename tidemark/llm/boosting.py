"""Gradient-boosted trees for two classes, on numpy: quantile bins, logistic loss, full trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Each level picks, for every node, the split of most gain; a node without one sends all rows left."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            gain = np.full(width, 1e-9)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = local * bins + binned[:, j]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins)
                h = np.bincount(cell, hess, width * bins).reshape(width, bins)
                gl, hl = g.cumsum(1)[:, : len(c)], h.cumsum(1)[:, : len(c)]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = ga - gl, ha - hl
                win = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - ga**2 / (ha + ridge)
                win[(hl < least) | (hr < least)] = 0
                at = win.argmax(1)
                best = win[np.arange(width), at]
                better = best > gain
                gain[better] = best[better]
                feature[first : first + width][better] = j
                threshold[first : first + width][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        value = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        score += value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(start, np.array(features), np.array(thresholds), np.array(values))
