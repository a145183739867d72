"""Gradient-boosted trees: fitted in numpy on a bounded table, evaluated as a Column."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, RIDGE = 30, 3, 0.3, 1.0


class Node(NamedTuple):
    feature: int
    above: float  # rows with a value above it go to `yes`
    no: Node | float
    yes: Node | float


class Trees(NamedTuple):
    base: float
    trees: list[Node | float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        def of(node, rows: np.ndarray) -> np.ndarray:
            if not isinstance(node, Node):
                return np.full(len(rows), node)
            out, yes = np.empty(len(rows)), rows[:, node.feature] > node.above
            out[yes], out[~yes] = of(node.yes, rows[yes]), of(node.no, rows[~yes])
            return out

        return self.base + sum(of(t, x) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        """The same margin, from a column for each feature."""

        def of(node) -> Column:
            if not isinstance(node, Node):
                return F.lit(round(node, 9))
            return F.when(features[node.feature] > node.above, of(node.yes)).otherwise(of(node.no))

        return sum((of(t) for t in self.trees), F.lit(round(self.base, 9)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains, exact splits halfway between values."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node | float:
        leaf = float(-RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
        if depth == 0 or len(rows) < 8:
            return leaf
        best = (1e-6, 0, 0.0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + RIDGE) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + RIDGE) - whole
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2))
        if best[0] <= 1e-6:
            return leaf
        _, f, above = best
        yes = x[rows, f] > above
        return Node(f, above, grow(rows[~yes], g, h, depth - 1), grow(rows[yes], g, h, depth - 1))

    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), q - y, q * (1 - q), DEPTH)
        trees.append(tree)
        margin = margin + Trees(0.0, [tree]).margin(x)
    return Trees(base, trees)


def threshold(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin from which on at least that share is positive; infinity if there is none."""
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # rows of one margin are selected together
    ends = np.append(margin[order][1:] < margin[order][:-1], True)
    good = np.flatnonzero((right >= precision) & ends)
    return float(margin[order[good[-1]]]) if len(good) else float("inf")
