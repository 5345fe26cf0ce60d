"""Gradient-boosted trees for a 0/1 label in numpy, flattened for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees as node arrays; a leaf points at itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60,
        depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0,
        least: float = 2.0) -> Forest:
    """Boost on the logistic loss.

    ``monotone[f]`` is 1 or -1 where the score may only rise or fall with feature
    f. A split that breaks this is not taken, and the values below a split stay on
    their side of its middle, so the constraint holds for the whole tree.
    """
    monotone = monotone or {}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rate_of_ones = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(0.0)
        return i

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        found = (1e-9, None)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            gs = np.cumsum(np.bincount(code[rows, f], weights=g[rows], minlength=size))[:-1]
            hs = np.cumsum(np.bincount(code[rows, f], weights=h[rows], minlength=size))[:-1]
            gr, hr = whole_g - gs, whole_h - hs
            a = np.clip(-gs / (hs + penalty), low, high)
            b = np.clip(-gr / (hr + penalty), low, high)
            loss = lambda v, gg, hh: gg * v + 0.5 * (hh + penalty) * v * v
            now = np.clip(-whole_g / (whole_h + penalty), low, high)
            gain = loss(now, whole_g, whole_h) - loss(a, gs, hs) - loss(b, gr, hr)
            bad = (hs < least) | (hr < least)
            if f in monotone:
                bad |= monotone[f] * (b - a) < 0
            gain = np.where(bad, -1.0, gain)
            k = int(np.argmax(gain))
            if gain[k] > found[0]:
                found = (float(gain[k]), (f, k, float(a[k]), float(b[k])))
        return found[1]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        i = node()
        split = best(rows, g, h, low, high) if level < depth else None
        if split is None:
            v = np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high)
            value[i] = rate * float(v)
            margin[rows] += value[i]
            return i
        f, k, a, b = split
        goes = code[rows, f] <= k
        middle = (a + b) / 2
        bounds = ((low, high), (low, high))
        if monotone.get(f) == 1:
            bounds = ((low, middle), (middle, high))
        elif monotone.get(f) == -1:
            bounds = ((middle, high), (low, middle))
        feature[i], threshold[i] = f, float(edges[f][k])
        left[i] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[i] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right),
                  np.array(value), np.array(roots), depth, base)
