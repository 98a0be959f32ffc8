"""Gradient-boosted trees for two classes, in numpy: histograms, Newton steps."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees of one depth as arrays: features and thresholds of inner nodes, and values of leaves."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: int = 10) -> Trees:
    n, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    logit = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            base = total_g**2 / (total_h + ridge)
            for f in range(n_features):
                size = len(edges[f]) + 1
                if size < 2:
                    continue
                at = local * size + binned[:, f]
                left_g, left_h, left_n = (np.cumsum(np.bincount(at, w, width * size).reshape(width, size), axis=1)[:, :-1] for w in (g, h, None))
                gain = left_g**2 / (left_h + ridge) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + ridge) - base[:, None]
                gain[(left_n < least) | (np.bincount(local, minlength=width)[:, None] - left_n < least)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                for w in np.flatnonzero(top > best):
                    best[w] = top[w]
                    features[k, first + w], thresholds[k, first + w] = f, edges[f][cut[w]]
            node = 2 * node + 1 + (x[np.arange(n), features[k][node]] > thresholds[k][node])
        leaf = node - inner
        values[k] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        logit += values[k][leaf]
    return Trees(features, thresholds, values, start)
