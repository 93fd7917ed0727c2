"""Small gradient-boosted trees: fitted on the driver on a bounded table, applied as one SQL expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """x[feature] <= at goes left; leaves are numbers."""

    feature: int
    at: float
    left: Split | float
    right: Split | float


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> float:
    return round(float(rate * g.sum() / (h.sum() + 1.0)), 6)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Split | float:
    best, place = 1e-9, None
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for at in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= at
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
                if gain > best:
                    best, place = gain, (f, float(at))
    if place is None:
        return _leaf(g, h, rate)
    low = x[:, place[0]] <= place[1]
    return Split(*place, _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 2, rate: float = 0.5) -> list[Split | float]:
    """Trees whose summed leaves are the log odds of y = 1."""
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, rate)
        out.append(tree)
        score += np.array([value(tree, row) for row in x])
    return out


def value(tree: Split | float, row: np.ndarray) -> float:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] <= tree.at else tree.right
    return tree


def scores(trees: list[Split | float], x: np.ndarray) -> np.ndarray:
    return np.array([sum(value(t, row) for t in trees) for row in x])


def calibrate(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on at least ``precision`` of the held-out rows are positive, halfway to the
    next lower score; infinity if there is none."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    s = score[order]
    last = np.r_[s[1:] != s[:-1], True]
    good = np.flatnonzero((hits >= precision) & last)
    if not len(good):
        return math.inf
    k = good[-1]
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def expression(trees: list[Split | float], features: list[Column]) -> Column:
    """The trees' sum as a column."""

    def of(tree: Split | float) -> Column:
        if isinstance(tree, Split):
            return F.when(features[tree.feature] <= F.lit(tree.at), of(tree.left)).otherwise(of(tree.right))
        return F.lit(float(tree))

    total = F.lit(0.0)
    for t in trees:
        total = total + of(t)
    return total
