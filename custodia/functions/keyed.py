"""Keyed pseudonyms as column expressions.

A plain hash of an identifier is undone by hashing a list of all identifiers.
These pseudonyms need a key:

``permute`` / ``restore``: integers to integers, reversible with the key. A
balanced Feistel network over the 64 bits: in each round one half is changed
by the first 32 bits of SHA-256(key | round | other half). Every integer has
exactly one pseudonym, so joins, counts and distinct ids are what they were.

``mac``: any identifier to the hex HMAC-SHA-256 under the key; not reversible.

The key is a text: a value, or a column. ``pseudonymise`` and ``restore_ids``
also take a scalar subquery over a keystore (``keystore_key``), which keeps
the key out of plans and logs. NULL stays NULL, and a NULL key gives NULLs.
All is done by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.functions.sealing import _KEYSTORE_SCHEMA

ROUNDS = 10
_HALF = 0xFFFFFFFF


def _key(key: Column | str) -> Column:
    if isinstance(key, str) and not key:
        raise ValueError("a key is required")
    return key if isinstance(key, Column) else F.lit(key)


def keystore_key(spark: SparkSession, keystore: str, name: str) -> Column:
    """The text of a key of a keystore, read while a job runs; NULL if the
    keystore does not hold it."""
    return spark.read.schema(_KEYSTORE_SCHEMA).json(keystore).where(F.col("name") == name).select("key").scalar()


def _round(key: Column, number: Column, half: Column) -> Column:
    text = F.concat_ws("|", key, number.cast("string"), half.cast("string"))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.when(key.isNotNull(), digest)              # concat_ws would pass over a NULL key


def _halves(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(_HALF))


def _joined(left: Column, right: Column) -> Column:
    return F.shiftleft(left, 32).bitwiseOR(right)


def permute(value: Column | str, key: Column | str, rounds: int = ROUNDS) -> Column:
    """The reversible pseudonym (long) of an integer column."""
    left, right = _halves((F.col(value) if isinstance(value, str) else value).cast("long"))
    key = _key(key)
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.alias("l"), right.alias("r")),
        lambda s, n: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(key, n, s["r"])).alias("r")),
        lambda s: _joined(s["l"], s["r"]))
    return done


def restore(value: Column | str, key: Column | str, rounds: int = ROUNDS) -> Column:
    """The integer whose pseudonym ``value`` is."""
    left, right = _halves((F.col(value) if isinstance(value, str) else value).cast("long"))
    key = _key(key)
    return F.aggregate(
        F.sequence(F.lit(rounds), F.lit(1)), F.struct(left.alias("l"), right.alias("r")),
        lambda s, n: F.struct(s["r"].bitwiseXOR(_round(key, n, s["l"])).alias("l"), s["l"].alias("r")),
        lambda s: _joined(s["l"], s["r"]))


def mac(value: Column | str, key: Column | str) -> Column:
    """Hex HMAC-SHA-256 of an identifier's text."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string").cast("binary")
    key = _key(key).cast("binary")
    short = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 128, "0")

    def pad(byte: int) -> Column:
        xored = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lpad(F.hex(
            F.conv(F.substr(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("long").bitwiseXOR(F.lit(byte))), 2, "0"))
        return F.unhex(F.array_join(xored, ""))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), text), 256))
    # a missing key must not make a pseudonym that anybody can make
    return F.when(key.isNotNull(), F.sha2(F.concat(pad(0x5C), inner), 256))


def pseudonymise(df: DataFrame, column: str, key: Column | str, method: str = "permute") -> DataFrame:
    """``df`` with an identifier replaced by its keyed pseudonym."""
    if method not in ("permute", "mac"):
        raise ValueError(f"unknown keyed pseudonym: {method!r}")
    made = permute if method == "permute" else mac
    return _with_key(df, column, key, made)


def restore_ids(df: DataFrame, column: str, key: Column | str) -> DataFrame:
    """``df`` with the integers behind ``permute`` pseudonyms."""
    return _with_key(df, column, key, restore)


def _with_key(df: DataFrame, column: str, key: Column | str, made) -> DataFrame:
    # a scalar subquery cannot stand inside a higher-order function
    own = "__key"
    while own in df.columns:
        own += "_"
    return (df.withColumn(own, _key(key)).withColumn(column, made(F.col(f"`{column}`"), F.col(own))).drop(own))
