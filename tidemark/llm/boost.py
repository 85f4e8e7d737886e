"""Gradient-boosted trees on binned features, for models small enough to fit at once."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with depth-wise trees over at most ``bins`` quantile bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.35, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray, used=None) -> np.ndarray:
        out = np.zeros(x.shape, np.int32)
        for k in range(x.shape[1]) if used is None else used:
            out[:, k] = np.searchsorted(self.edges[k], x[:, k], "left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], at, method="lower")) for k in range(x.shape[1])]
        binned, n, width = self._binned(x), len(x), x.shape[1]
        flat = binned + np.arange(width) * self.bins
        mean = np.average(y, weights=weight)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = weight * (y - p), weight * p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int32), np.zeros(size)
            node = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                local = node - first
                live = np.flatnonzero((local >= 0) & (local < count))
                g = np.bincount(local[live], gradient[live], count)
                h = np.bincount(local[live], curve[live], count)
                value[first : first + count] = g / (h + self.l2)
                if level == self.depth or len(live) == 0:
                    break
                cells = (local[live, None] * (width * self.bins) + flat[live]).ravel()
                shape = (count, width, self.bins)
                hg = np.bincount(cells, np.repeat(gradient[live], width), count * width * self.bins).reshape(shape)
                hh = np.bincount(cells, np.repeat(curve[live], width), count * width * self.bins).reshape(shape)
                lg, lh = hg.cumsum(2), hh.cumsum(2)
                rg, rh = g[:, None, None] - lg, h[:, None, None] - lh
                gain = lg**2 / (lh + self.l2) + rg**2 / (rh + self.l2) - (g**2 / (h + self.l2))[:, None, None]
                gain[(lh < 1e-3) | (rh < 1e-3)] = 0
                best = gain.reshape(count, -1).argmax(1)
                split = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
                feature[first : first + count] = np.where(split, best // self.bins, -1)
                cut[first : first + count] = best % self.bins
                chosen = feature[node[live]]
                moved = live[chosen >= 0]
                right = binned[moved, feature[node[moved]]] > cut[node[moved]]
                node[moved] = 2 * node[moved] + 1 + right
            value *= self.rate
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        used = np.unique(np.concatenate([f[f >= 0] for f, _, _ in self.trees]))
        binned = self._binned(x, used)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = binned[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            score += value[node]
        return 1 / (1 + np.exp(-score))
