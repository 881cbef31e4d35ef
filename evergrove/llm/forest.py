"""Random forests of binary classification trees, written out as expressions."""

from __future__ import annotations

import numpy as np

from evergrove.llm.boosting import Tree


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 4, seed: int = 11) -> list[Tree]:
    """Trees on bootstrap samples; every split tries a random third of the
    features and takes the best Gini gain.  A leaf holds its share of class 1."""
    rng = np.random.default_rng(seed)
    features = x.shape[1]
    tries = max(1, features // 3)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T] if len(x) else [np.empty(0)] * features
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x)) if len(x) else np.empty(0, int)
        size = 2 ** (depth + 1) - 1
        tree = Tree([-1] * size, [0.0] * size, [0.5] * size)
        todo = [(0, rows)]
        while todo:
            at, own = todo.pop()
            share = float(y[own].mean()) if len(own) else 0.5
            tree.value[at] = share
            if 2 * at + 2 >= size or len(own) < 2 * least or share in (0.0, 1.0):
                continue
            best, choice = 1e-9, None
            for k in rng.choice(features, tries, replace=False):
                for cut in cuts[k]:
                    right = x[own, k] > cut
                    n = int(right.sum())
                    if n < least or len(own) - n < least:
                        continue
                    p, q = y[own][right].mean(), y[own][~right].mean()
                    gain = share * (1 - share) - (n * p * (1 - p) + (len(own) - n) * q * (1 - q)) / len(own)
                    if gain > best:
                        best, choice = gain, (int(k), float(cut))
            if choice:
                tree.feature[at], tree.threshold[at] = choice
                right = x[own, choice[0]] > choice[1]
                todo += [(2 * at + 1, own[~right]), (2 * at + 2, own[right])]
        forest.append(tree)
    return forest


def forest_share(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([tree.predict(x) for tree in forest], axis=0)


def forest_column(forest: list[Tree], columns: list):
    total = forest[0].column(columns)
    for tree in forest[1:]:
        total = total + tree.column(columns)
    return total / float(len(forest))
