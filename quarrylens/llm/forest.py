"""A small random forest: bootstrap samples, a random choice of features at each split, Gini impurity."""

from __future__ import annotations

import numpy as np


class Tree:
    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
        self.feature, self.limit, self.left, self.right, self.value = [], [], [], [], []
        self.grow(x, y, rng, depth, least)
        self.arrays = tuple(np.array(a) for a in (self.feature, self.limit, self.left, self.right, self.value))

    def grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> int:
        node = len(self.feature)
        for held, value in ((self.feature, -1), (self.limit, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()))):
            held.append(value)
        best = (0.0, -1, 0.0)
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, hits = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y) + 1)
                cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (len(y) - n[:-1] >= least))
                if len(cut):
                    p, q = hits[cut] / n[cut], (hits[-1] - hits[cut]) / (len(y) - n[cut])
                    impurity = (n[cut] * p * (1 - p) + (len(y) - n[cut]) * q * (1 - q)) / len(y)
                    k = int(impurity.argmin())
                    gain = y.mean() * (1 - y.mean()) - impurity[k]
                    if gain > best[0] + 1e-12:
                        best = (gain, int(f), float(v[cut[k]]))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.feature[node], self.limit[node] = best[1], best[2]
            self.left[node] = self.grow(x[low], y[low], rng, depth - 1, least)
            self.right[node] = self.grow(x[~low], y[~low], rng, depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, limit, left, right, value = self.arrays
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= limit[node], left[node], right[node])
        return value[at]


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
        self.trees = [Tree(x[p], y[p].astype(float), rng, depth, least) for p in picks]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The chance of a positive, by row."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
