"""Gradient-boosted regression trees for the logistic loss, small and exact, and their SQL form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] < self.cut, self.low.predict(x), self.high.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(features[self.feature] < self.cut, self.low.column(features)).otherwise(self.high.column(features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Node:
    leaf = Node(float(-rate * g.sum() / (h.sum() + 1)))
    if not depth or len(x) < 20:
        return leaf
    best = (1e-6, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    _, j, cut = best
    if j < 0:
        return leaf
    low = x[:, j] < cut
    return Node(feature=j, cut=cut, low=_grow(x[low], g[low], h[low], depth - 1, rate), high=_grow(x[~low], g[~low], h[~low], depth - 1, rate))


@dataclass(frozen=True)
class BoostedTrees:
    """Sum of trees, then Platt calibration ``1 / (1 + exp(-(slope * sum + offset)))``."""

    trees: tuple[Node, ...]
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> BoostedTrees:
        """Every third row is kept for the calibration."""
        held = np.arange(len(x)) % 3 == 2
        total, trees = np.zeros((~held).sum()), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            tree = _grow(x[~held], p - y[~held], p * (1 - p), depth, rate)
            total += tree.predict(x[~held])
            trees.append(tree)
        s, t = BoostedTrees(tuple(trees)).raw(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(200):
            e = 1 / (1 + np.exp(-(a * s + b))) - t
            a, b = a - 0.05 * float((e * s).mean() + 1e-3 * (a - 1)), b - 0.05 * float(e.mean())
        return BoostedTrees(tuple(trees), a, b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability as an expression."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + tree.column(features)
        return 1 / (1 + F.exp(-(total * self.slope + self.offset)))
