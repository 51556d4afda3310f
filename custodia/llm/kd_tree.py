"""K-d trees over small integer vectors, searched by L1 distance in bulk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class KdTree:
    """Inner node: dimension, bound (left: at most the bound), two children.
    Leaf: dimension -1 and its number in ``left``."""

    dim: list[int]
    bound: list[int]
    left: list[int]
    right: list[int]
    n_leaves: int


def build(points: np.ndarray, most: int) -> tuple[KdTree, list[np.ndarray]]:
    """A tree whose leaves hold at most ``most`` points, or equal ones, and
    the points of each leaf. Every split is the most even one to be had."""
    dim, bound, left, right, leaves = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        here = len(dim)
        for part in (dim, bound, left, right):
            part.append(-1)
        mine = points[rows]
        split = _even_split(mine) if len(rows) > most else None
        if split is None:
            left[here] = len(leaves)
            leaves.append(rows)
            return here
        dim[here], bound[here] = split
        low = mine[:, split[0]] <= split[1]
        left[here] = grow(rows[low])
        right[here] = grow(rows[~low])
        return here

    grow(np.arange(len(points)))
    return KdTree(dim, bound, left, right, len(leaves)), leaves


def _even_split(points: np.ndarray) -> tuple[int, int] | None:
    n, d = points.shape
    high = points.max(axis=0)
    bounds = [np.full(d, t) for t in (0, 1, 2)] + [np.median(points, axis=0).astype(np.int64), high - 1]
    best = (0, None)
    for bound in bounds:
        low = (points <= bound).sum(axis=0)
        even = np.minimum(low, n - low)
        k = int(even.argmax())
        if even[k] > best[0]:
            best = (int(even[k]), (k, int(bound[k])))
    return best[1]


def reached(tree: KdTree, points: np.ndarray, within: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each leaf, the points whose L1 distance to the leaf's box is at
    most ``within``; boxes farther away are pruned with all below them."""
    d = points.shape[1]
    far = np.iinfo(np.int32).max
    stack = [(0, np.arange(len(points)), np.zeros(len(points), np.int32),
              np.full(d, -far, np.int64), np.full(d, far, np.int64))]
    while stack:
        node, rows, away, low, high = stack.pop()
        k, t = tree.dim[node], tree.bound[node]
        if k < 0:
            yield tree.left[node], rows
            continue
        x = points[rows, k].astype(np.int64)
        rest = away - np.maximum(np.maximum(low[k] - x, x - high[k]), 0)
        for child, lo, hi in ((tree.left[node], low[k], min(high[k], t)),
                              (tree.right[node], max(low[k], t + 1), high[k])):
            dist = rest + np.maximum(np.maximum(lo - x, x - hi), 0)
            near = dist <= within
            if near.any():
                low_, high_ = low.copy(), high.copy()
                low_[k], high_[k] = lo, hi
                stack.append((child, rows[near], dist[near].astype(np.int32), low_, high_))
