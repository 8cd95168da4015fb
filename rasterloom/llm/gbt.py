"""Gradient-boosted trees with monotonic constraints, flattened into numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All nodes of all trees in five arrays; a leaf points to itself. ``bias`` is the score before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``; every tree takes a step for all rows at once."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rising: tuple[int, ...] = (), trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 64, ridge: float = 1.0, least_rows: float = 5.0) -> Trees:
    """Boosting of the logistic loss. The score never falls as a feature in ``rising`` grows.

    Labels of one kind, or no rows, give a constant score.
    """
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    bias = float(np.log(share / (1 - share)))
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, d), int)
    nodes: list[list] = []
    roots = []
    f_now = np.full(len(x), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        weight = lambda a, b: float(np.clip(-a / (b + ridge), lo, hi))
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
        own = weight(gs, hs)
        nodes.append([0, np.inf, me, me, own * rate])
        if level == depth or len(rows) < 2 * least_rows:
            return me
        best = (1e-6, None)
        for f in range(d):
            k = len(cuts[f])
            if not k:
                continue
            n_l = np.cumsum(np.bincount(binned[rows, f], minlength=k + 1))[:k]
            g_l = np.cumsum(np.bincount(binned[rows, f], g[rows], k + 1))[:k]
            h_l = np.cumsum(np.bincount(binned[rows, f], h[rows], k + 1))[:k]
            for c in np.flatnonzero((n_l >= least_rows) & (len(rows) - n_l >= least_rows)):
                wl, wr = weight(g_l[c], h_l[c]), weight(gs - g_l[c], hs - h_l[c])
                if f in rising and wl > wr:
                    continue
                gain = gain_of(g_l[c], h_l[c], wl) + gain_of(gs - g_l[c], hs - h_l[c], wr) - gain_of(gs, hs, own)
                if gain > best[0]:
                    best = (gain, (f, c, wl, wr))
        if best[1] is None:
            return me
        f, c, wl, wr = best[1]
        mid = (wl + wr) / 2
        bounds = ((lo, mid), (mid, hi)) if f in rising else ((lo, hi), (lo, hi))
        goes = binned[rows, f] <= c
        nodes[me][:2] = f, float(cuts[f][c])
        nodes[me][2] = grow(rows[goes], g, h, *bounds[0], level + 1)
        nodes[me][3] = grow(rows[~goes], g, h, *bounds[1], level + 1)
        nodes[me][4] = 0.0
        return me

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f_now))
            roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), -np.inf, np.inf, 0))
            at = np.full(len(x), roots[-1])
            for _ in range(depth):
                fe, th = np.array([nodes[i][0] for i in at]), np.array([nodes[i][1] for i in at])
                at = np.where(x[np.arange(len(x)), fe] <= th, [nodes[i][2] for i in at], [nodes[i][3] for i in at])
            f_now = f_now + np.array([nodes[i][4] for i in at])
    a = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    return Trees(np.array(a[0], np.int64), np.array(a[1], float), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4], float), np.array(roots, np.int64), depth, bias)
