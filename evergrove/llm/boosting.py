"""Gradient-boosted trees on binned dense features, with isotonic calibration.

Fitting runs on the driver over a bounded matrix; scoring is either numpy over
batches or a plain Spark expression (``score_column``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tree:
    """A complete binary tree in heap order; ``feature`` -1 marks a leaf."""

    feature: list[int]
    threshold: list[float]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold, value = np.array(self.feature), np.array(self.threshold), np.array(self.value)
        while True:
            split = feature[node] >= 0
            if not split.any():
                return value[node]
            own = np.flatnonzero(split)
            at = node[own]
            node[own] = 2 * at + 1 + (x[own, feature[at]] > threshold[at])

    def column(self, columns: list, node: int = 0):
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        left, right = self.column(columns, 2 * node + 1), self.column(columns, 2 * node + 2)
        return F.when(columns[self.feature[node]] > F.lit(float(self.threshold[node])), right).otherwise(left)


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self.rate * tree.predict(x)
        return total

    def column(self, columns: list):
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + F.lit(float(self.rate)) * tree.column(columns)
        return total


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss over feature quantiles.

    ``ridge`` is the leaves' L2 penalty and ``least`` the least Hessian weight of
    a child.  With rows of one class only, or none, the model is a constant.
    """
    positives = float(y.sum())
    base = float(np.log((positives + 0.5) / (len(y) - positives + 0.5)))
    model = Boosted(base, rate)
    if not 0 < positives < len(y):
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    codes = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    width = bins + 1
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = sigmoid(margin)
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        size = 2 ** (depth + 1) - 1
        tree = Tree([-1] * size, [0.0] * size, [0.0] * size)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth + 1):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == at)
                if not len(own):
                    continue
                g, h = gradient[own].sum(), hessian[own].sum()
                tree.value[at] = float(g / (h + ridge))
                if level == depth or h < 2 * least:
                    continue
                best, choice = 1e-6, None
                for k, edge in enumerate(edges):
                    if not len(edge):
                        continue
                    gs = np.cumsum(np.bincount(codes[own, k], gradient[own], width))[: len(edge)]
                    hs = np.cumsum(np.bincount(codes[own, k], hessian[own], width))[: len(edge)]
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(hs < least) | (h - hs < least)] = -1
                    if gain.max(initial=-1) > best:
                        best, choice = float(gain.max()), (k, int(gain.argmax()))
                if choice is not None:
                    k, cut = choice
                    tree.feature[at], tree.threshold[at] = k, float(edges[k][cut])
                    node[own] = 2 * at + 1 + (codes[own, k] > cut)
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model


@dataclass
class Isotonic:
    """A non-decreasing step function, linear between its knots."""

    knots: np.ndarray
    values: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.knots, self.values)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators.  Each pool counts half a row of either class
    more, so that no probability is exactly 0 or 1; knots are pool means."""
    if not len(y):
        return Isotonic(np.array([-1.0, 1.0]), sigmoid(np.array([-1.0, 1.0])))
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # rows, positives, sum of margins
    for m, label in zip(margin[order], y[order]):
        pools.append([1.0, float(label), float(m)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, positives, total = np.array(pools).T
    return Isotonic(total / n, np.maximum.accumulate((positives + 0.5) / (n + 1)))
