"""Histogram gradient-boosted trees in numpy, kept as flat arrays.

All trees are complete binary trees of one depth: node i has the children
2 i + 1 and 2 i + 2, so a forest is three arrays and a batch of rows walks down
all of its trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``threshold``: trees by inner nodes; ``value``: trees by leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 2.0,
) -> Forest:
    """Boost the logistic loss. ``ridge`` smooths leaves; a split leaves at least ``least`` rows' worth of weight a side.

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    n, width = x.shape[0], max(x.shape[1], 1)
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1)
    forest = Forest(
        float(np.log(share / (1 - share))),
        np.zeros((trees, inner), np.int64),
        np.full((trees, inner), np.inf),
        np.zeros((trees, inner + 1)),
    )
    if n < 2 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    cell = coded + np.arange(width) * bins
    margin = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + cell).ravel()
            shape = (count, width, bins)
            g, h, m = (
                np.bincount(at, np.repeat(w, width) if w is not None else None, count * width * bins)
                .reshape(shape)
                .cumsum(2)
                for w in (grad, hess, None)
            )
            all_g, all_h, all_m = g[:, :1, -1:], h[:, :1, -1:], m[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where((m >= least) & (all_m - m >= least), gain, -np.inf).reshape(count, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(count), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                if b < len(cuts[f]):
                    forest.feature[t, first + k], forest.threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        forest.value[t] = -rate * g / (h + ridge)
        margin += forest.value[t][leaf]
    return forest
