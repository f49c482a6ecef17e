"""Gradient-boosted trees for small feature sets, fitted on a bounded labelled sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: logistic loss, regression trees of fixed depth over quantile cuts.

    A tree is (feature, cut, left, right) per inner node in level order and a value
    per leaf, so a prediction is a few array look-ups per tree."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit on rows of ``x`` with labels 0 or 1."""
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                for n in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == n)
                    best = self._split(binned[rows], grad[rows], hess[rows], cuts) if len(rows) > 8 else None
                    if best:
                        feature[n], cut[n] = best[0], cuts[best[0]][best[1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + 1.0)
            score += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    @staticmethod
    def _split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
        best, found, g, h = 1e-6, None, grad.sum(), hess.sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[:, f], grad, len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[:, f], hess, len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, k)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; each tree is a few comparisons of whole columns."""
        columns = np.ascontiguousarray(np.asarray(x, np.float64).T)
        score = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:

            def leaf(node: int, feature=feature, cut=cut, value=value) -> np.ndarray | float:
                if node >= len(feature):
                    return value[node - len(feature)]
                low, high = leaf(2 * node + 1), leaf(2 * node + 2)
                if not np.isfinite(cut[node]):
                    return low
                return np.where(columns[feature[node]] > cut[node], high, low)

            score += leaf(0)
        return 1 / (1 + np.exp(-score))
