"""Cohorts as exact bitmaps: a stored index, its algebra, and row selection.

One pass over the measurements gives every subject one flag per cohort; the
flags become bitmaps of 32,768 subjects each, one row per bucket of ids, with
a column pair per cohort: the members and, among all subjects seen, the
others. So a cohort, its complement, and AND, OR and AND NOT of any of them
are merges of bitmaps bucket by bucket. The index holds about a bit per
subject and column (4 KB per bucket and column); a cohort question reads the
index alone.

Ids are integers (negative ones too). Rows without an id belong to nobody.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, salted_join

BITS = 32768
_BYTES = BITS // 8
BUCKET = "bucket"


def _names(name: str) -> tuple[str, str]:
    return f"in_{name}", f"out_{name}"


def cohort_index(rows: DataFrame, cohorts: Mapping[str, Column | str], key: str = "patientId") -> DataFrame:
    """(bucket, in_<name>, out_<name>, ...): a subject is in a cohort if any
    of its rows satisfies the condition. Two shuffles: one row per subject
    and task, then one bitmap per bucket and task."""
    kind = rows.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"bitmaps need integer ids, {key} is {kind.simpleString()}")
    if not cohorts:
        raise ValueError("no cohort is named")
    conditions = {n: F.expr(c) if isinstance(c, str) else c for n, c in cohorts.items()}
    subjects = (rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
                .agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())))
    position = F.bitmap_bit_position("id")

    def bitmap(hit: Column) -> Column:
        return F.bitmap_construct_agg(F.when(hit, position))
    return (subjects.groupBy(F.bitmap_bucket_number("id").alias(BUCKET))
            .agg(*(bitmap(hit).alias(name) for n in conditions
                   for name, hit in zip(_names(n), (F.col(n), ~F.col(n))))))


@dataclass(frozen=True)
class Cohort:
    """A set of subjects as a formula over an index: ``a & b``, ``a | b``,
    ``a - b`` (and not) and ``~a`` (all other subjects of the index).

    Kept as an OR of ANDs of index columns, so it needs no operation that a
    merge of bitmaps does not have.
    """

    terms: tuple[frozenset[str], ...]

    @classmethod
    def named(cls, name: str) -> "Cohort":
        return cls((frozenset([_names(name)[0]]),))

    def __or__(self, other: "Cohort") -> "Cohort":
        return Cohort(_smallest([*self.terms, *other.terms]))

    def __and__(self, other: "Cohort") -> "Cohort":
        return Cohort(_smallest([a | b for a in self.terms for b in other.terms]))

    def __invert__(self) -> "Cohort":
        out = None
        for term in self.terms:
            others = Cohort(tuple(frozenset([_opposite(c)]) for c in sorted(term)))
            out = others if out is None else out & others
        return out if out is not None else Cohort((frozenset(),))

    def __sub__(self, other: "Cohort") -> "Cohort":
        return self & ~other


def _opposite(column: str) -> str:
    side, _, name = column.partition("_")
    return f"{'out' if side == 'in' else 'in'}_{name}"


def _smallest(terms: list[frozenset[str]]) -> tuple[frozenset[str], ...]:
    """Without impossible terms and without those that another one covers."""
    possible = {t for t in terms if not any(_opposite(c) in t for c in t)}
    return tuple(sorted((t for t in possible if not any(o < t for o in possible)), key=sorted))


def members(index: DataFrame, cohort: Cohort) -> DataFrame:
    """(bucket, bits): the bitmap of a cohort, one row per bucket; buckets
    without members may be left out. The index is read once."""
    unknown = sorted({c for t in cohort.terms for c in t} - set(index.columns))
    if unknown:
        raise ValueError(f"the index has no columns {unknown}")
    if frozenset() in cohort.terms:                      # everybody: some column or its opposite
        one = index.columns[1]
        cohort = Cohort((frozenset([one]), frozenset([_opposite(one)])))
    if not cohort.terms:
        return index.where("false").select(BUCKET, F.lit(None).cast("binary").alias("bits"))
    # a row per term and column, merged by AND within the term, then by OR
    parts = F.array(*(F.struct(F.lit(k).alias("term"), F.col(c).alias("bits"))
                      for k, t in enumerate(cohort.terms) for c in sorted(t)))
    each = index.select(BUCKET, F.explode(parts).alias("p")).select(BUCKET, "p.term", "p.bits")
    terms = each.groupBy(BUCKET, "term").agg(F.bitmap_and_agg("bits").alias("bits"))
    return terms.groupBy(BUCKET).agg(F.bitmap_or_agg("bits").alias("bits"))


def cohort_size(bitmap: DataFrame) -> DataFrame:
    """One row, ``n``: the subjects of a bitmap."""
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def _byte(bits: Column, at: Column) -> Column:
    """Byte ``at`` (from 0) of a binary as a number."""
    return F.conv(F.hex(F.substr(bits, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def cohort_ids(bitmap: DataFrame, key: str = "patientId") -> DataFrame:
    """The ids of a bitmap, each once."""
    some = (bitmap.select(BUCKET, "bits", F.explode(F.sequence(F.lit(0), F.lit(_BYTES - 1))).alias("at"))
            .select(BUCKET, "at", _byte(F.col("bits"), F.col("at")).alias("byte")).where("byte <> 0"))
    bits = some.select(BUCKET, "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    position = F.col("at") * 8 + F.col("bit")
    # the number of a bucket counts from 1 for positive ids and from 0 down for the others
    one = F.when(F.col(BUCKET) > 0, (F.col(BUCKET) - 1) * BITS + position + 1).otherwise(
        F.col(BUCKET) * BITS - position)
    return bits.where("(shiftright(byte, bit) & 1) = 1").select(one.cast("long").alias(key))


def rows_in(rows: DataFrame, bitmap: DataFrame, key: str = "patientId", negate: bool = False,
            skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """The rows whose subject is in the bitmap's cohort (``negate``: is not;
    rows without an id are then kept, as NOT EXISTS keeps them).

    Rows meet the bitmap of their bucket of ids, a side of a few KB per
    32,768 subjects, and test one bit; no ids are joined.
    """
    own, bits = (_unused(rows, n) for n in ("bucket", "bits"))
    side = bitmap.select(F.col(BUCKET).alias(own), F.col("bits").alias(bits))
    id_ = F.col(f"`{key}`").cast("long")
    joined = salted_join(rows.withColumn(own, F.bitmap_bucket_number(id_)), side, own, "left", skew)
    position = F.bitmap_bit_position(id_)
    byte = _byte(F.col(bits), F.floor(position / 8))
    # shifts by a column: divide by the power of two
    bit = F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))).cast("int").bitwiseAND(F.lit(1))
    hit = F.coalesce(bit == 1, F.lit(False))
    return joined.where(~hit if negate else hit).select(*(F.col(f"`{c}`") for c in rows.columns))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
