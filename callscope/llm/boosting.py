"""Gradient-boosted trees for a yes/no label, small enough to be broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, as arrays [tree, inner node] and [tree, leaf]."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.25,
        bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton steps on the logistic loss; splits are looked for between quantiles of each feature."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = (1 << depth) - 1
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            gain, chosen = np.zeros(many), np.full((many, 2), -1)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell = (node - first) * bins + binned[:, f]
                g = np.cumsum(np.bincount(cell, slope, many * bins).reshape(many, bins), axis=1)
                h = np.cumsum(np.bincount(cell, bend, many * bins).reshape(many, bins), axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                better = g ** 2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g ** 2 / (all_h + ridge)
                better = better[:, :len(cuts[f])]
                at = better.argmax(axis=1)
                best = better[np.arange(many), at]
                win = best > gain + 1e-9
                gain[win] = best[win]
                chosen[win] = np.stack([np.full(many, f), at], axis=1)[win]
            for k in range(many):
                if chosen[k, 0] >= 0:
                    features[t, first + k], thresholds[t, first + k] = chosen[k, 0], cuts[chosen[k, 0]][chosen[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
        leaves[t] = rate * g / (h + ridge)
        score += leaves[t][leaf]
    return Trees(features, thresholds, leaves, base)
