"""Reading tables and keeping intermediate results for the operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.session import ensure_checkpoint_dir
from custodia.sources.files import Folders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES = threading.local()


#: Spark removes a write's shuffle files as it ends, not when the driver
#: next collects its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that ``kept`` stores inside, once the block ends:
    for callers that have written or collected their result by then. The
    block gets a form of ``kept`` whose tables outlast it: they are left to
    the block around it, if there is one."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    outer = scopes[-1] if scopes else []
    scopes.append([])
    try:
        yield lambda df: _stored(df, outer)
    finally:
        folders = Folders(spark)
        for path in scopes.pop():
            folders.delete(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder.

    Later jobs neither repeat its work nor depend on one executor, and plan
    with its real size (a checkpoint keeps the estimates of the plan before
    it, which multiply from join to join). Its shuffle files go at once.
    Inside ``removed_after`` the files go at its end; otherwise they stay in
    the folder that ``spark.checkpoint.dir`` names until its owner clears it.
    """
    scopes = getattr(_SCOPES, "open", None)
    return _stored(df, scopes[-1] if scopes else [])


def _stored(df: DataFrame, paths: list[str]) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    paths.append(path)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The rows of ``counts`` with the largest ``n``, at most ``limit`` of
    them, and the bound that their ``n`` reaches.

    The bound comes from a histogram with 16 steps an octave, so no task
    and not the driver sees more than ``limit`` rows; rows of the step that
    would exceed it are all left out.
    """
    octave = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = counts.groupBy(octave.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    total, bound = 0, 1 << 62
    for r in sorted(steps.collect(), key=lambda r: -r.step):
        total += r.rows
        if total > limit:
            break
        bound = r.least
    return counts.filter(F.col("n") >= bound), bound
