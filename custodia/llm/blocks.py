"""Queries against all rows, block by block.

Vectors are dealt out in blocks, each with a copy of the queries, and a task
sorts its rows so that the vectors of a block come first and the queries pass
by. It holds one block, bounded in rows and values, and one batch of queries;
neither vectors nor queries go through the driver. Blocks are dealt by row, so
equal vectors and repeated ids spread evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and values that a block holds at most; rows that are worth a task.
BLOCK_ROWS = 16384
BLOCK_VALUES = 1 << 22
LEAST_ROWS = 256

#: (id, ids found, scores) of one query.
Answer = tuple[int, np.ndarray, np.ndarray]


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float = 1.0) -> DataFrame:
    """(id, v) without NULL ids and vectors, and without vectors that have a
    NULL component or one that is not finite (also after ``scale``)."""
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite))


def _dealt(data: DataFrame, queries: DataFrame, block_rows: int) -> DataFrame:
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = size.n, max(1, size.d or 1)
    block_rows = max(1, min(block_rows, BLOCK_VALUES // d))
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block_rows), min(tasks, n // LEAST_ROWS))
    vectors = (data.withColumn("row", F.monotonically_increasing_id())
               .select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"),
                       F.size("v").alias("length"), "id", "v"))
    asked = (queries.distinct()
             .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"),
                     F.size("v").alias("length"), "id", "v"))
    return (vectors.unionByName(asked).repartition("block")
            .sortWithinPartitions("block", "length", "asks"))


def _runner(build: Callable, answer: Callable[..., Iterable[Answer]], scores: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, ids, parts = None, None, [], []
        for batch in batches:
            numbers, asks, length, row_ids = (np.asarray(batch.column(k)) for k in range(4))
            vectors = batch.column(4)
            keys = np.stack([numbers, length, asks], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found: list[Answer] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if lo == hi:
                    continue
                here, d = (int(numbers[lo]), int(length[lo])), int(length[lo])
                matrix = np.asarray(vectors.slice(lo, hi - lo).flatten(), np.float64).reshape(hi - lo, d)
                if here != key:
                    key, block, ids, parts = here, None, [], []
                if not asks[lo]:
                    ids.append(row_ids[lo:hi])
                    parts.append(matrix)
                    continue
                if block is None:
                    if not parts:
                        continue                  # a block without vectors of this length
                    block = build(np.concatenate(ids), np.concatenate(parts))
                    ids, parts = [], []
                found += answer(block, row_ids[lo:hi].tolist(), matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])),
                 pa.array(np.concatenate([np.zeros(0, scores.to_pandas_dtype()), *(f[2] for f in found)]), scores)],
                names=["query_id", "vec_id", "score"])
    return run


def best_of_blocks(data: DataFrame, queries: DataFrame, build: Callable, answer: Callable[..., Iterable[Answer]],
                   k: int, score: str, ascending: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best answers of each query
    over all blocks, ties to the smaller id. ``build(ids, vectors)`` makes a
    block of vectors of one length, ``answer(block, ids, vectors)`` gives the
    best in it for each of some queries of that length."""
    kind = pa.int64() if score == "long" else pa.float64()
    found = _dealt(data, queries, block_rows).mapInArrow(
        _runner(build, answer, kind), f"query_id long, vec_id long, score {score}")
    best = F.col("score").asc() if ascending else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
