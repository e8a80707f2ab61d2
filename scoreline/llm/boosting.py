"""Gradient-boosted trees with monotonic constraints, as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees: a leaf points to itself, so every row takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values, one numpy step for each level of each tree over all rows."""
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    directions: list[int],
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    l2: float = 1.0,
    least: int = 10,
) -> Trees:
    """Logistic loss; directions[f] is +1 or -1 where the margin may only rise or fall with f.

    A constrained split is taken only if its sides are in order, and the middle of the two sides
    bounds everything below them, so the order holds across the whole tree.
    """
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = codes + np.arange(width) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    node: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add() -> int:
        k = len(node["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", 0.0)):
            node[name].append(v)
        return k

    def grow(k: int, at: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = gradient[at], curvature[at]
        total_g, total_h = g.sum(), h.sum()
        value = float(np.clip(total_g / (total_h + l2), low, high))
        if level < depth and len(at) >= 2 * least:
            cells = flat[at].ravel()
            sums = [
                np.bincount(cells, np.repeat(v, width), width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                for v in (g, h, np.ones(len(at)))
            ]
            gl, hl, nl = sums
            gr, hr = total_g - gl, total_h - hl
            left = np.clip(gl / (hl + l2), low, high)
            right = np.clip(gr / (hr + l2), low, high)
            gain = (2 * gl * left - (hl + l2) * left**2) + (2 * gr * right - (hr + l2) * right**2)
            gain -= 2 * total_g * value - (total_h + l2) * value**2
            allowed = (nl >= least) & (len(at) - nl >= least)
            allowed &= (np.array(directions)[:, None] * (right - left)) >= 0
            gain = np.where(allowed, gain, -1)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > 1e-6 and b < len(edges[f]):
                node["feature"][k], node["threshold"][k] = int(f), float(edges[f][b])
                below = codes[at, f] <= b
                middle = (left[f, b] + right[f, b]) / 2
                bounds = [(low, high), (low, high)]
                if directions[f] > 0:
                    bounds = [(low, middle), (middle, high)]
                elif directions[f] < 0:
                    bounds = [(middle, high), (low, middle)]
                for side, rows, (a, c) in (("left", at[below], bounds[0]), ("right", at[~below], bounds[1])):
                    node[side][k] = child = add()
                    grow(child, rows, level + 1, a, c)
                return
        node["value"][k] = rate * value
        margin[at] += rate * value

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        roots.append(add())
        grow(roots[-1], np.arange(n), 0, -np.inf, np.inf)
    arrays = {k: np.array(v) for k, v in node.items()}
    return Trees(**arrays, roots=np.array(roots), depth=depth, start=start)
