"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy. The models are small and pickle."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  #: by node, children of node i at 2i + 1 and 2i + 2; -1 in a leaf
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[node]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return self.value[node]


@dataclass
class Boosted:
    base: float = 0.0
    rate: float = 0.1
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Boosted:
    """Logistic loss, Newton steps, splits from histograms; `least` is the smallest sum of second derivatives in a leaf."""
    n, m = x.shape
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(mean / (1 - mean))), rate)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    coded = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    score = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size), depth)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            live = (local >= 0) & (local < count)
            best = np.full(count, 1e-6)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                at = local[live] * k + coded[live, j]
                gs = np.bincount(at, g[live], count * k).reshape(count, k).cumsum(1)
                hs = np.bincount(at, h[live], count * k).reshape(count, k).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = -1
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(count), top] > best):
                    best[i] = gain[i, top[i]]
                    tree.feature[first + i], tree.cut[first + i] = j, cuts[j][top[i]]
            f = tree.feature[node]
            split = live & (f >= 0)
            node[split] = 2 * node[split] + 1 + (x[split, f[split]] > tree.cut[node[split]])
        tree.value = np.bincount(node, g, size) / (np.bincount(node, h, size) + l2)
        score += rate * tree.value[node]
        model.trees.append(tree)
    return model


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising (raw, probability) points, for np.interp."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of raw
    for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][2] += c
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
