"""Gradient-boosted regression trees for two classes, over features cut into a few bins; plain numpy."""

from __future__ import annotations

import numpy as np

TREES = 60
DEPTH = 5
RATE = 0.2
BINS = 32
LEAST = 8
PULL = 1.0


class Boosted:
    """Log-odds of the second class: a sum of depth-limited trees, each fitted to the gradient of the log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        self.features: list[np.ndarray] = []
        self.limits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            score += self._grow(binned, cuts, y - p, p * (1 - p))

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """Add a complete tree of DEPTH levels; returns what it adds to the score of each row."""
        inner = (1 << DEPTH) - 1
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(slope), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, split = 1e-6, None
            if len(rows) >= 2 * LEAST:
                g, h = slope[rows].sum(), bend[rows].sum()
                for f in range(binned.shape[1]):
                    if not len(cuts[f]):
                        continue
                    bins = binned[rows, f]
                    left_g = np.cumsum(np.bincount(bins, slope[rows], len(cuts[f]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins, bend[rows], len(cuts[f]) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
                    gain = left_g**2 / (left_h + PULL) + (g - left_g) ** 2 / (h - left_h + PULL) - g**2 / (h + PULL)
                    gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, split = gain[k], (f, k)
            if split:
                feature[node], limit[node] = split[0], cuts[split[0]][split[1]]
                right = binned[rows, split[0]] > split[1]
                at[rows] = 2 * node + 1 + right
            else:
                at[rows] = 2 * node + 1
        leaf = at - inner
        size = 1 << DEPTH
        value = RATE * np.bincount(leaf, slope, size) / (np.bincount(leaf, bend, size) + PULL)
        self.features.append(feature)
        self.limits.append(limit)
        self.leaves.append(value)
        return value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            score += leaf[at - len(feature)]
        return score
