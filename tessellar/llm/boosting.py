"""Gradient-boosted trees for two classes on a bounded table of numbers, with monotonic constraints.

Second-order boosting of the logistic loss over binned features. A constraint (-1 or +1 for a feature) makes the score non-increasing or
non-decreasing in it: a split in the wrong order is not taken, and both sides' values are held on their side of the split's middle all the
way down. A fitted model is a set of flat node arrays, one row a tree, and scores all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT, LEAST_GAIN = 60, 3, 128, 0.2, 1.0, 1.0, 1e-6


@dataclass
class Forest:
    """Arrays of shape (trees, nodes): a node with ``feature`` -1 is a leaf of ``value``; others send x <= ``split`` to ``left``, else to ``left + 1``."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        at, rows = np.zeros((len(x), len(trees)), np.int64), np.arange(len(x))[:, None]
        for _ in range(DEPTH if len(trees) else 0):
            f = self.feature[trees, at]
            down = self.left[trees, at] + (x[rows, np.maximum(f, 0)] > self.split[trees, at])
            at = np.where(f < 0, at, down)
        return self.bias + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(column: np.ndarray) -> np.ndarray:
    """Up to ``BINS`` - 1 middles between neighbouring different values, as evenly over the rows as they are."""
    values = np.sort(column)
    steps = np.flatnonzero(values[1:] > values[:-1])
    if len(steps) >= BINS:
        wanted = np.linspace(0, len(values) - 1, BINS + 1)[1:-1]
        steps = np.unique(steps[np.minimum(np.searchsorted(steps, wanted), len(steps) - 1)])
    return (values[steps] + values[steps + 1]) / 2


def _best_split(binned, of, g, h, signs, low, high, edges):
    """(gain, feature, bin, left value, right value) of the best allowed split of the rows ``of``, or None."""
    value = lambda gs, hs: np.clip(-gs / (hs + L2), low, high)
    gain_of = lambda gs, hs, v: -(gs * v + (hs + L2) * v * v / 2)
    g_all, h_all = g[of].sum(), h[of].sum()
    before, best = gain_of(g_all, h_all, value(g_all, h_all)), None
    for f, sign in enumerate(signs):
        n = len(edges[f])
        if not n:
            continue
        gl = np.bincount(binned[of, f], g[of], n + 1).cumsum()[:-1]
        hl = np.bincount(binned[of, f], h[of], n + 1).cumsum()[:-1]
        vl, vr = value(gl, hl), value(g_all - gl, h_all - hl)
        gain = gain_of(gl, hl, vl) + gain_of(g_all - gl, h_all - hl, vr) - before
        gain[(hl < LEAST_WEIGHT) | (h_all - hl < LEAST_WEIGHT) | (sign * (vr - vl) < 0)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > (best[0] if best else LEAST_GAIN):
            best = (gain[k], f, k, vl[k], vr[k])
    return best


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, rate: float = RATE) -> Forest:
    """A forest for the rows of ``x`` and their classes ``y`` (0, 1); ``signs`` holds a constraint (-1, 0, 1) for each feature.

    With rows of one class only, or none, there are no trees: the bias decides (class 1 where there are no rows)."""
    size = (2 << DEPTH) - 1
    blank = lambda: (np.full(size, -1), np.zeros(size), np.zeros(size, np.int64), np.zeros(size))
    ones = float(y.mean()) if len(y) else 1.0
    bias = float(np.log((ones + 1e-6) / (1 - ones + 1e-6)))
    grown = []
    if 0 < ones < 1:
        edges = [_edges(c) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        margin = np.full(len(x), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            feature, split, left, value = blank()
            todo, used = [(0, np.arange(len(x)), 0, -np.inf, np.inf)], 1
            while todo:
                node, of, depth, low, high = todo.pop()
                value[node] = rate * np.clip(-g[of].sum() / (h[of].sum() + L2), low, high)
                found = _best_split(binned, of, g, h, signs, low, high, edges) if depth < DEPTH else None
                if found is None:
                    margin[of] += value[node]
                    continue
                _, f, k, vl, vr = found
                feature[node], split[node], left[node] = f, edges[f][k], used
                goes_left, middle = binned[of, f] <= k, (vl + vr) / 2
                bounds = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] < 0 else ((low, high), (low, high))
                todo += [(used, of[goes_left], depth + 1, *bounds[0]), (used + 1, of[~goes_left], depth + 1, *bounds[1])]
                used += 2
            if feature[0] < 0:
                break
            grown.append((feature, split, left, value))
    columns = [np.array([t[i] for t in grown]).reshape(len(grown), size) for i in range(4)]
    return Forest(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3], bias)
