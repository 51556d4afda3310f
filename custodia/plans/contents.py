"""What a staged or moved table holds: row count and an order-independent
digest, taken while the rows are written.

The digest of a table is the sum of its rows' SHA-256 values, as four limbs of
60 bits each. It does not depend on order, files or partitions, rows that
repeat count each time, and the digests of parts add up to that of the whole.
Each row is read as its columns by name, every value framed by its length, so
no two different rows have the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMBS = 4
_HEX_DIGITS = 15


@dataclass(frozen=True)
class Contents:
    """Rows and digest of a table; ``+`` is the union of tables."""

    rows: int = 0
    limbs: tuple[int, ...] = (0,) * LIMBS

    def __add__(self, other: "Contents") -> "Contents":
        return Contents(self.rows + other.rows, tuple(a + b for a, b in zip(self.limbs, other.limbs)))

    @property
    def digest(self) -> str:
        return ":".join(f"{x}" for x in self.limbs)

    @classmethod
    def parse(cls, rows: int, digest: str) -> "Contents":
        return cls(int(rows), tuple(int(x) for x in digest.split(":")))


def _text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.TimestampType):
        return F.unix_micros(c).cast("string")      # the same in every time zone
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(c)) if not isinstance(f.dataType, T.VariantType) else F.to_json(c)
    return c.cast("string")


def row_hash(schema: T.StructType) -> Column:
    """Hex SHA-256 of a row: columns by name, each as length and value."""
    framed = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        text = _text(f)
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def content_sums(schema: T.StructType) -> list[Column]:
    """The aggregates behind ``Contents``: rows and the limb sums."""
    h = row_hash(schema)
    limbs = [F.conv(F.substring(h, 1 + k * _HEX_DIGITS, _HEX_DIGITS), 16, 10).cast("decimal(20,0)")
             for k in range(LIMBS)]
    return [F.count(F.lit(1)).alias("rows"),
            *(F.coalesce(F.sum(x), F.lit(0).cast("decimal(30,0)")).alias(f"limb{k}") for k, x in enumerate(limbs))]


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its contents observed by whatever job reads it."""
    seen = Observation(name)
    return df.observe(seen, *content_sums(df.schema)), seen


def contents_of(seen: Observation) -> Contents:
    found = seen.get
    return Contents(int(found["rows"]), tuple(int(found[f"limb{k}"]) for k in range(LIMBS)))


def table_contents(df: DataFrame) -> DataFrame:
    """One row (rows, digest) of a table, by one aggregation."""
    limbs = [F.col(f"limb{k}").cast("string") for k in range(LIMBS)]
    return df.agg(*content_sums(df.schema)).select("rows", F.concat_ws(":", *limbs).alias("digest"))
