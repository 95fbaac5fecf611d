"""Small gradient-boosted trees: fitted in numpy, applied as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

#: A leaf value, or (feature, threshold, tree where the value is lower, other tree).
Tree = float | tuple


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, names: list[str], depth: int, rate: float) -> Tree:
    total_g, total_h = gradient.sum(), hessian.sum()
    leaf = round(float(-rate * total_g / (total_h + 1.0)), 4)
    if depth == 0 or len(x) < 8:
        return leaf
    best = (1e-3, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        cuts = (values[1:] + values[:-1]) / 2
        for cut in cuts[np.unique(np.linspace(0, len(cuts) - 1, 24).astype(int))] if len(cuts) else ():
            low = x[:, j] < cut
            g, h = gradient[low].sum(), hessian[low].sum()
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g ** 2 / (total_h + 1)
            if gain > best[0]:
                best = (gain, j, float(cut))
    _, j, cut = best
    if j is None:
        return leaf
    low = x[:, j] < cut
    return (names[j], cut, *(_grow(x[m], gradient[m], hessian[m], names, depth - 1, rate) for m in (low, ~low)))


def _value(tree: Tree, x: np.ndarray, names: list[str]) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, names.index(tree[0])] < tree[1]
    return np.where(low, _value(tree[2], x, names), _value(tree[3], x, names))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 16, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Trees whose sum is the log odds of *y*."""
    trees: list[Tree] = []
    logit = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        trees.append(_grow(x, p - y, p * (1 - p), names, depth, rate))
        logit += _value(trees[-1], x, names)
    return trees


def predict(trees: list[Tree], x: np.ndarray, names: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-sum(_value(t, x, names) for t in trees)))


def expression(trees: list[Tree], feature: Callable[[str], Column]) -> Column:
    """The probability that the trees give, as an expression over feature columns."""
    def of(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(feature(tree[0]) < tree[1], of(tree[2])).otherwise(of(tree[3]))

    logit = of(trees[0])
    for tree in trees[1:]:
        logit = logit + of(tree)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
