"""Gradient-boosted trees for two classes, in numpy: logistic loss, quantile bins, trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete binary trees in arrays: node i has children 2i+1 and 2i+2; a node that does not split sends all rows left."""

    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base = 0.0
        self.features = np.zeros((0, 2**depth - 1), dtype=np.intp)
        self.limits = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner = 2**self.depth - 1
        features, limits, leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            feature, limit = np.zeros(inner, dtype=np.intp), np.full(inner, np.inf)
            node = np.zeros(n, dtype=np.intp)
            for level in range(self.depth):
                first, number = 2**level - 1, 2**level
                best = np.full(number, 1e-6)
                local = node - first
                for j in range(width):
                    size = len(edges[j]) + 1
                    if size == 1:
                        continue
                    at = local * size + binned[j]
                    g = np.bincount(at, gradient, number * size).reshape(number, size).cumsum(axis=1)
                    h = np.bincount(at, weight, number * size).reshape(number, size).cumsum(axis=1)
                    c = np.bincount(at, minlength=number * size).reshape(number, size).cumsum(axis=1)
                    right_g, right_h, right_c = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                    gain = g**2 / (h + self.ridge) + right_g**2 / (right_h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    gain[(c < self.least) | (right_c < self.least)] = 0
                    place = gain.argmax(axis=1)
                    value = gain[np.arange(number), place]
                    for i in np.flatnonzero(value > best):
                        best[i] = value[i]
                        feature[first + i], limit[first + i] = j, edges[j][min(place[i], len(edges[j]) - 1)]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
            leaf = node - inner
            g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
            leaves.append(self.rate * g / (h + self.ridge))
            score += leaves[-1][leaf]
            features.append(feature)
            limits.append(limit)
        self.features, self.limits, self.leaves = np.array(features), np.array(limits), np.array(leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.intp)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return total
