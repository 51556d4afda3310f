"""Nearest neighbours by query-centred collision counting.

Vectors are projected on ``PROJECTIONS`` random directions, and each
projection is a sorted array. A query opens a window around its own value in
every array. The window is as wide as a radius asks for, and the radius grows
step by step (virtual rehashing: the arrays stay as they are). A vector that
lies in a window collides; with ``THRESHOLD`` collisions it is verified by its
distance. The search of a query ends when as many verified vectors as asked
for lie within the radius: a vector within the radius r collides in a window
of half width ``WINDOW`` * r with a fixed probability in each array, so with
these numbers it misses the threshold with a probability under one in a
thousand. When the windows hold everything, everything has been verified, so
a search always ends with whole answers.

The vectors are dealt out in blocks, each with its own arrays, and every block
answers all queries (``blocks``).

Defined cases: vectors that are NULL, of zeros alone or with a NULL or
non-finite component take no part, nor rows with a NULL id; vectors are
compared with those of the same length; a query never meets rows of its own
id; rows that repeat an id are candidates each for itself, and one query per
different vector, whose answers are ranked together; ties go to the smaller
id; distances beyond the range of a double are infinite; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.blocks import BLOCK_ROWS, Answer, best_of_blocks, valid_vectors

PROJECTIONS = 64
#: Collisions that make a candidate, and half the window's width in radii: a
#: vector at the radius itself collides in an array with probability 0.84.
THRESHOLD = 44
WINDOW = 1.4
GROWTH = 1.2
#: Growth while there are not as many verified vectors as asked for.
LEAP = 2.0


def directions(length: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, PROJECTIONS))


class Block:
    """Vectors of one length with a sorted array per projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int):
        self.ids, self.vectors = ids, vectors
        # large components would overflow in the projections
        self.unit = float(np.abs(vectors).max(initial=0)) or 1.0
        self.axes = directions(vectors.shape[1], seed)
        values = (vectors / self.unit) @ self.axes
        self.order = np.ascontiguousarray(values.argsort(axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), self.order, axis=1)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, nearest first."""
        n, m = len(self.ids), PROJECTIONS
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.nan_to_num((query / self.unit) @ self.axes)
        middle = np.array([np.searchsorted(self.sorted[j], at[j]) for j in range(m)])
        lo, hi = middle.copy(), middle.copy()
        hits = np.zeros(n, np.int32)
        open_ = self.ids != own
        want = min(k, int(open_.sum()))
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        radius = self._first_radius(at, middle, min(n, k + 1))
        while want:
            left = [np.searchsorted(self.sorted[j], at[j] - WINDOW * radius, "left") for j in range(m)]
            right = [np.searchsorted(self.sorted[j], at[j] + WINDOW * radius, "right") for j in range(m)]
            fresh = [self.order[j, a:b] for j in range(m)
                     for a, b in ((min(left[j], lo[j]), lo[j]), (hi[j], max(right[j], hi[j]))) if b > a]
            lo, hi = np.minimum(lo, left), np.maximum(hi, right)
            if fresh:
                hits += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            whole = bool((lo == 0).all() and (hi == n).all())
            new = np.flatnonzero(open_ & (hits >= THRESHOLD)) if not whole else np.flatnonzero(open_)
            open_[new] = False
            with np.errstate(over="ignore", invalid="ignore"):
                apart = self.vectors[new] - query
                ids = np.concatenate([ids, self.ids[new]])
                dist = np.concatenate([dist, np.sqrt((apart * apart).sum(axis=1))])
            if len(ids) > 4 * k:                    # keep what can still be an answer
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            if whole or len(ids) >= want and np.partition(dist, want - 1)[want - 1] <= radius * self.unit:
                break
            # far below the first answers wide steps cost nothing but verifications
            radius *= GROWTH if len(ids) >= want else LEAP
        best = np.lexsort((ids, dist))[:k]
        return ids[best], dist[best]

    def _first_radius(self, at: np.ndarray, middle: np.ndarray, k: int) -> float:
        """Half of the radius at which the middle array's window holds k vectors."""
        n = len(self.ids)
        reach = []
        for j, p in enumerate(middle):
            some = self.sorted[j, max(0, p - k):min(n, p + k)]
            reach.append(np.sort(np.abs(some - at[j]))[k - 1])
        return max(float(np.median(reach)) / (2 * WINDOW), 1e-12)


def nearest(rows: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found, for every row
    of ``rows`` whose id satisfies ``asks`` (a condition on ``id``)."""
    data = valid_vectors(rows, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))

    def build(ids: np.ndarray, vectors: np.ndarray) -> Block:
        return Block(ids, vectors, seed)

    def answer(block: Block, ids: list[int], queries: np.ndarray) -> Iterator[Answer]:
        for own, query in zip(ids, queries):
            yield own, *block.search(own, query, k)

    return best_of_blocks(data, data.filter(asks), build, answer, k, "double", True, block_rows)
