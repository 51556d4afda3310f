"""Skew-safe equi-join of a large fact table with a per-key table.

The clinical plans join measurement rows (many per patient) to per-patient
rows (profiles, consent clauses, cohort ids). A single patient, source or
test batch may hold a large share of all measurements, and a plain
shuffle join then sends that share to one task.

``salted_join`` first probes the fact's key column for hot keys: one
pre-aggregated pass (counts are combined map-side, so a hot key costs one
partial count per task). A key is hot when it holds at least
``rows_per_task`` rows and at least 1 / ``max_hot`` of all rows, so there are
never more than ``max_hot`` hot keys and none is left out. With no hot key
the plan is the plain join and Catalyst/AQE pick the strategy. Each hot key
gets salts in proportion to its size (about ``rows_per_task`` rows per salt,
a power of two): its fact rows are spread over those salts, and its per-key
rows are replicated once per salt. Cold keys keep salt 0. The result equals
the plain join exactly: each fact row meets each matching per-key row once.

NULL keys match nothing, so where they stay in the result (``left``,
``left_anti``) a hot NULL is spread in the same way with no replicas at all.

The salt is a hash of the row and of the input partition it comes from.
Equal rows of one input partition share a salt, equal rows of different
partitions do not, and a task that is run again assigns the same salts.
Columns that cannot be hashed (maps, variants) are left out of the hash.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALT = "_salt"
_N = "_n"


@dataclass(frozen=True)
class SkewPolicy:
    """How to guard a fact-to-key join against hot keys.

    rows_per_task: a key is hot with at least this many rows; a hot key gets
                   about one salt (one task) per this many rows.
    max_hot:       a key is hot with at least 1 / max_hot of all rows, which
                   bounds the number of hot keys. Smaller keys are joined
                   unsalted.
    max_buckets:   upper bound on the salts of one key (None: no bound).
    buckets:       fixed salt count for every hot key instead (tests).
    """

    rows_per_task: int = 1_000_000
    max_buckets: int | None = None
    max_hot: int = 1 << 14
    buckets: int | None = None

    def __post_init__(self):
        given = [n for n in (self.max_buckets, self.buckets) if n is not None]
        if min(self.rows_per_task, self.max_hot, *given) < 1:
            raise ValueError("SkewPolicy values must be positive")

    def salts_for(self, rows: int) -> int:
        """Salt count for a key with ``rows`` rows."""
        if self.buckets is not None:
            return self.buckets
        want = -(-rows // self.rows_per_task)  # ceil
        salts = 1
        while salts < want and (self.max_buckets is None or salts < self.max_buckets):
            salts <<= 1
        return max(salts, 2)

    def is_hot(self, rows: int, total: int) -> bool:
        """Whether a key with ``rows`` of ``total`` rows is hot."""
        return rows >= self.rows_per_task and rows * self.max_hot >= total


DEFAULT_SKEW = SkewPolicy()


def key_counts(fact: DataFrame, key: str) -> DataFrame:
    """Rows per key, NULL included, combined map-side."""
    return fact.groupBy(key).agg(F.count(F.lit(1)).alias(_N))


def hot_keys(counts: DataFrame, key: str, policy: SkewPolicy = DEFAULT_SKEW,
             total: int | None = None) -> dict:
    """{hot key: salt count} from one row per key with its count ``_n``.

    The largest ``max_hot`` keys come to the driver (a per-task top-k, merged);
    all hot keys are among them. ``total`` is the sum of all counts; without
    it, it is observed in the same pass.
    """
    seen = None
    if total is None:
        seen = Observation("hot_keys")
        counts = counts.observe(seen, F.sum(_N).alias("total"))
    top = (counts.where(F.col(_N) >= F.lit(policy.rows_per_task))
           .orderBy(F.col(_N).desc(), F.col(key)).limit(policy.max_hot).select(key, _N).collect())
    if not top:
        return {}
    if seen is not None:
        total = seen.get["total"]
    return {r[key]: policy.salts_for(r[_N]) for r in top if policy.is_hot(r[_N], total)}


def find_hot_keys(fact: DataFrame, key: str, policy: SkewPolicy = DEFAULT_SKEW) -> dict:
    """Run the hot-key probe on a fact table: {key: salt count}; the key is
    None when NULL keys are hot."""
    return hot_keys(key_counts(fact, key), key, policy)


def _by_salts(hot: Mapping) -> list[tuple[int, list]]:
    groups: dict[int, list] = defaultdict(list)
    for k, salts in hot.items():
        groups[int(salts)].append(k)
    return sorted(groups.items())


def _case(key: Column, hot: Mapping, branch, default: Column) -> Column:
    """CASE over the salt classes; each class is one hash-set lookup."""
    expr = F
    for salts, keys in _by_salts(hot):
        expr = expr.when(key.isin(keys), branch(salts))
    return default if expr is F else expr.otherwise(default)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def salted_join(fact: DataFrame, keyed: DataFrame, key: str, how: str = "inner",
                policy: SkewPolicy | None = DEFAULT_SKEW,
                hot: Mapping | None = None) -> DataFrame:
    """``fact.join(keyed, key, how)`` with hot keys split over salts.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti`` (the
    fact side is preserved). ``policy=None`` gives the plain join. ``hot``
    ({key: salts}, None for the NULL key) passes a known probe result (any
    superset of the real one is still exact, so a probe of a larger table can
    be reused); otherwise the probe runs now, as one small job.
    """
    if policy is None:
        return fact.join(keyed, key, how)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not preserve the fact side for {how!r}")
    if hot is None:
        hot = find_hot_keys(fact, key, policy)
    hot = {k: s for k, s in hot.items() if s > 1}
    null_salts = hot.pop(None, None)
    if how in ("inner", "left_semi"):
        null_salts = None       # rows with a NULL key leave anyway
    if not hot and null_salts is None:
        return fact.join(keyed, key, how)
    if how in ("inner", "left_semi"):
        # said here, because no filter passes below the salt
        fact = fact.where(F.col(key).isNotNull())
    k = F.col(key)
    hashed = [f.name for f in fact.schema.fields if _hashable(f.dataType)]
    row_hash = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in hashed])
    salt = _case(k, hot, lambda s: F.pmod(row_hash, F.lit(s)), F.lit(0))
    if null_salts is not None:
        salt = F.when(k.isNull(), F.pmod(row_hash, F.lit(null_salts))).otherwise(salt)
    replicas = _case(k, hot, lambda s: F.sequence(F.lit(0), F.lit(s - 1)), F.array(F.lit(0)))
    joined = fact.withColumn(SALT, salt.cast("int")).join(
        keyed.withColumn(SALT, F.explode(replicas)), [key, SALT], how)
    # Same column order as the plain using-join: key, fact columns, keyed columns.
    out = [key] + [c for c in fact.columns if c != key]
    if how not in ("left_semi", "left_anti"):
        out += [c for c in keyed.columns if c != key]
    return joined.select(*out)
