"""Gradient-boosted regression trees for a yes-or-no question, in numpy, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Complete trees of one depth: per tree and inner node a feature and a cut (go right where the
    feature is above it), per leaf a value; ``bias`` is the log odds before any tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
        penalty: float = 1.0, least_weight: float = 2.0) -> Boosted:
    """Newton boosting of the logistic loss. With one class only, every answer is that class."""
    share = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y) or y.min() == y.max():
        return Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), bias)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), bias)
    model = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                    np.zeros((trees, leaves)), bias)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            best = np.full(2 ** level, 1e-6)
            chosen = np.full((2 ** level, 2), -1)
            slot = (node - first) * BINS
            for f in range(x.shape[1]):
                g = np.bincount(slot + binned[:, f], gradient, BINS * 2 ** level).reshape(-1, BINS).cumsum(1)
                h = np.bincount(slot + binned[:, f], weight, BINS * 2 ** level).reshape(-1, BINS).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g ** 2 / (h + penalty) + gr ** 2 / (hr + penalty) - (
                    g[:, -1:] ** 2 / (h[:, -1:] + penalty))
                gain[(h < least_weight) | (hr < least_weight)] = -1
                gain[:, len(cuts[f]):] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(gain)), at]
                better = top > best
                best[better] = top[better]
                chosen[better] = np.stack([np.full(better.sum(), f), at[better]], axis=1)
            for k, (f, at) in enumerate(chosen):
                if f >= 0:
                    model.feature[tree, first + k] = f
                    model.cut[tree, first + k] = cuts[f][at]
            feature, cut = model.feature[tree, node], model.cut[tree, node]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature] > cut)
        at = node - inner
        g, h = np.bincount(at, gradient, leaves), np.bincount(at, weight, leaves)
        model.leaf[tree] = rate * g / (h + penalty)
        score += model.leaf[tree][at]
    return model
