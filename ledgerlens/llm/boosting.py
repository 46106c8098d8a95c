"""Gradient-boosted trees for yes-or-no labels, and calibrated thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, RATE = 40, 3, 0.2
BINS = 32
#: Weight that keeps small leaves near nothing, and the least weight of a leaf.
SHRINK, LEAST_WEIGHT = 1.0, 1.0


@dataclass
class Tree:
    """Complete tree: inner node i splits on ``feature[i]`` at ``limit[i]`` (larger goes right to 2i + 2)."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.limit[node])
        return self.leaf[node - (2**DEPTH - 1)]


@dataclass
class Model:
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((RATE * t(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: what share of such rows is positive."""
        return _logistic(self.slope * self.margin(x) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x: np.ndarray, binned: np.ndarray, limits: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for i in range(inner):
        rows = np.flatnonzero(node == i)
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, 0, np.inf)
        for f, cuts in enumerate(limits):
            if not len(cuts) or not len(rows):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g, len(cuts) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h, len(cuts) + 1))[:-1]
            right_g, right_h = g.sum() - left_g, h.sum() - left_h
            gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), f, cuts[gain.argmax()])
        feature[i], limit[i] = best[1:]
        node[rows] = 2 * i + 1 + (x[rows, feature[i]] > limit[i])
    at = node - inner
    leaf = -np.bincount(at, gradient, inner + 1) / (np.bincount(at, hessian, inner + 1) + SHRINK)
    return Tree(feature, limit, leaf)


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where a feature may be split: quantiles of its ``values``, each of which is there ``counts`` times."""
    if not len(values):
        return np.zeros(0)
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    ranks = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (upto[-1] - 1))
    cuts = np.unique(values[order][np.searchsorted(upto, ranks, side="right")])
    return cuts[cuts < values.max()]


def train(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, limits: list[np.ndarray] | None = None) -> Model:
    """Fits the logistic loss by second-order steps. Rows stand for ``counts`` rows each; ``limits``: the cuts of every feature."""
    counts = np.ones(len(x)) if counts is None else counts
    share = np.clip((y * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3)
    model = Model(base=float(np.log(share / (1 - share))))
    limits = limits or [cuts_of(x[:, f], counts) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(cuts, x[:, f]) for f, cuts in enumerate(limits)])
    margin = np.full(len(x), model.base)
    for _ in range(TREES):
        p = _logistic(margin)
        tree = _grow(x, binned, limits, counts * (p - y), counts * np.maximum(p * (1 - p), 1e-6))
        model.trees.append(tree)
        margin += RATE * tree(x)
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Fits slope and offset of the margin to rows that were not trained on, by Newton steps."""
    counts = np.ones(len(x)) if counts is None else counts
    margin = model.margin(x)
    design = np.column_stack([margin, np.ones(len(margin))])
    weights = np.array([1.0, 0.0])
    for _ in range(25):
        p = _logistic(design @ weights)
        slope = design.T @ (counts * (p - y)) + 0.01 * (weights - [1, 0])
        curve = (design * (counts * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        weights = weights - np.linalg.solve(curve, slope)
    if np.isfinite(weights).all() and weights[0] > 0:
        model.slope, model.offset = map(float, weights)


def threshold(probability: np.ndarray, y: np.ndarray, precision: float, counts: np.ndarray | None = None) -> float:
    """The lowest probability from which on up the rows have this precision; 2 (nothing passes) if there is none."""
    counts = np.ones(len(y)) if counts is None else counts
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum((y * counts)[order]) / np.cumsum(counts[order])
    last = np.append(probability[order][1:] != probability[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(probability[order][good[-1]]) if len(good) else 2.0
