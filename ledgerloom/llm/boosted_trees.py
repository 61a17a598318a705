"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Training takes a bounded sample (see the callers). A fitted model is five arrays of equal length
over all nodes of all trees, so that scoring a block of rows is a few numpy gathers per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees one after another; a leaf points at itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of ``x`` (rows, features)."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of at most ``bins`` bins with about equal counts."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        ridge: float = 1.0, least_rows: int = 5) -> FlatTrees:
    """Fit by Newton steps on the logistic loss; without rows or with one class a constant (0.5 without rows)."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, f], bins) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else x.astype(int)
    score = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add() -> int:
        for column, first in ((feature, 0), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            column.append(first)
        left[-1] = right[-1] = len(left) - 1
        return len(left) - 1

    def gain(g, h):
        return g * g / (h + ridge)

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        root = add()
        roots.append(root)
        open_ = [(root, np.arange(n))]
        for level in range(depth + 1):
            following = []
            for node, rows in open_:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, 0, 0)
                if level < depth and len(rows) >= 2 * least_rows:
                    for f in range(width):
                        if not len(cuts[f]):
                            continue
                        size, b = len(cuts[f]) + 1, binned[rows, f]
                        gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                        hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                        won = np.where((nl >= least_rows) & (len(rows) - nl >= least_rows), gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h), -1.0)
                        at = int(np.argmax(won))
                        if won[at] > best[0]:
                            best = (won[at], f, at)
                if best[0] <= 1e-6:
                    value[node] = float(rate * g / (h + ridge))
                    score[rows] += value[node]
                    continue
                _, f, at = best
                feature[node], threshold[node] = f, float(cuts[f][at])
                goes = binned[rows, f] <= at
                left[node], right[node] = add(), add()
                following += [(left[node], rows[goes]), (right[node], rows[~goes])]
            open_ = following
    return FlatTrees(base, np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int),
                     np.array(right, int), np.array(value), depth)
