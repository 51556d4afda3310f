"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors lie column by column: a block of candidates is one matrix whose
rows are dimensions. For a query the scores of all candidates of a block
are accumulated some dimensions at a time. After each step a candidate
whose partial score plus a bound of what the remaining dimensions can add
(the product of the remaining lengths of both vectors) stays under the
query's k-th best score is dropped, and the survivors are compacted.

Every block of candidates answers all queries (``blocks``), with at most k
answers per query, and the merge takes the best k.

Components become ``floor(scale * x)``. Where scores can exceed 2**53, which
is tested for each block and query, they are computed in whole numbers of any
size; a score beyond the range of a long is given as its limit.

Defined cases: a vector that is NULL or has a NULL or non-finite component
(also after scaling) takes no part; vectors are compared with those of the same length only; a
row with a NULL id takes no part; a query never meets rows of its own id;
rows that repeat an id are candidates each for themselves, and one query
per different vector, whose answers are ranked together; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from custodia.llm.blocks import Answer, best_of_blocks, valid_vectors

QUERY_BLOCK = 4096
DIMENSION_BLOCK = 16
CANDIDATE_BLOCK = 16384

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _rest_lengths(matrix: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """For each cut, the length of what lies beyond it (rounded up)."""
    squares = matrix * matrix
    return [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts]


def _search(query: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray,
            rest: list[np.ndarray], cuts: list[int], k: int, floor: float):
    """Best k of one candidate block: scores and positions, at least floor."""
    score = np.where(ids == own, -np.inf, 0.0)
    alive = None                              # None: all of the block
    start = 0
    q_rest = [float(np.sqrt((query[c:] ** 2).sum())) * (1 + 1e-9) for c in cuts]
    for step, cut in enumerate(cuts):
        part = columns[start:cut] if alive is None else columns[start:cut, alive]
        score = score + query[start:cut] @ part
        start = cut
        if cut == len(query):
            break
        slack = q_rest[step] * (rest[step] if alive is None else rest[step][alive])
        low = floor
        if len(score) >= k:
            sure = score - slack
            low = max(low, np.partition(sure, len(sure) - k)[len(sure) - k])
        keep = score + slack >= low
        if keep.sum() < 0.7 * len(keep):
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            score = score[keep]
    where = np.arange(len(ids)) if alive is None else alive
    mine = np.isfinite(score) & (score >= floor)
    return score[mine], where[mine]


def _search_exactly(query: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray, k: int):
    """The same in whole numbers of any size, for scores that a double does
    not hold. Rounded scores with a bound of their error leave the rest out."""
    with np.errstate(all="ignore"):
        rough = query @ columns
        slack = (np.abs(query) @ np.abs(columns)) * (2 * len(query) + 4) * 2.0 ** -52
        sure, most = rough - slack, rough + slack
    other = ids != own
    if other.sum() > k and np.isfinite(sure).all() and np.isfinite(most).all():
        other &= most >= np.sort(sure[other])[-k]
    q = [int(x) for x in query]
    exact = sorted((-sum(a * int(b) for a, b in zip(q, columns[:, j])), int(ids[j])) for j in np.flatnonzero(other))[:k]
    return (np.array([min(max(-s, -_LONG - 1), _LONG) for s, _ in exact], np.int64),
            np.array([i for _, i in exact], np.int64))


class Block:
    """Candidates of one length, column by column."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, d = ids, vectors.shape[1]
        self.columns = np.ascontiguousarray(vectors.T)
        self.cuts = [*range(DIMENSION_BLOCK, d, DIMENSION_BLOCK), d]
        with np.errstate(over="ignore"):
            self.rest = _rest_lengths(self.columns, self.cuts)
            self.length = float(np.sqrt((self.columns * self.columns).sum(axis=0)).max(initial=0))

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best, best first."""
        with np.errstate(over="ignore", invalid="ignore"):
            small = self.length * float(np.sqrt((query * query).sum())) < _EXACT
        if not small:
            score, ids = _search_exactly(query, own, self.columns, self.ids, k)
            return ids, score
        score, where = _search(query, own, self.columns, self.ids, self.rest, self.cuts, k, -np.inf)
        ids = self.ids[where]
        top = np.lexsort((ids, -score))[:k]
        return ids[top], score[top].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0,
          id_col: str = "vec_id", vector_col: str = "embedding",
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows.
    ``query_block`` queries at most are turned into whole numbers at once."""
    def build(ids: np.ndarray, found: np.ndarray) -> Block:
        return Block(ids, np.floor(scale * found))

    def answer(block: Block, ids: list[int], asked: np.ndarray) -> Iterator[Answer]:
        for at in range(0, len(ids), query_block):
            whole = np.floor(scale * asked[at:at + query_block])
            for own, query in zip(ids[at:at + query_block], whole):
                yield own, *block.best(own, query, k)

    data, asked = (valid_vectors(df, id_col, vector_col, scale) for df in (vectors, queries))
    return best_of_blocks(data, asked, build, answer, k, "long", False, CANDIDATE_BLOCK)
