"""Column encryption as expressions: sealed cells and keystores.

A policy answers with encryption properties. Parquet's own encryption needs a
key service that the cluster provides; where the properties name one (a crypto
factory), they go to the Parquet writer as they are. Where they name only keys
and the columns they protect, the columns are sealed here, cell by cell, with
authenticated AES (GCM) by built-in functions, and written as binary columns
that any reader of Parquet can carry.

A keystore is a small JSON table (name, key in base64) on storage that only
readers with a right to the keys can open; its path is a property. Key bytes
are read by scalar subqueries while a job runs, so they stand in no plan text,
no event log and no file of the data.

A sealed cell is two bytes that choose one of 4,096 subkeys, the nonce, the
cipher text and its tag. The subkeys are derived from the key and the column
name (SHA-256), so no single AES key comes near the number of random nonces
that is safe, and a cell moved to another column does not open. NULL stays
NULL. The column's metadata carries the key's name and the type.
"""

from __future__ import annotations

import base64
import json
import secrets
from dataclasses import dataclass, field
from typing import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parquet's property names for its own encryption.
COLUMN_KEYS = "parquet.encryption.column.keys"
CRYPTO_FACTORY = "parquet.crypto.factory.class"
#: Path of the keystore that sealed columns are written and read with.
KEYSTORE = "custodia.keystore"

SEALED = "custodia.sealed"
SUBKEYS = 4096
_KEYSTORE_SCHEMA = "name string, key string"


class KeyUnavailable(PermissionError):
    """A key is needed that the keystore does not hold."""


@dataclass(frozen=True)
class Sealing:
    """Which key protects which column, and where the keys are."""

    keys: Mapping[str, str] = field(default_factory=dict)       # column -> key name
    keystore: str | None = None

    def __bool__(self) -> bool:
        return bool(self.keys)


def parse_column_keys(text: str) -> dict[str, str]:
    """``key: column, column; key: column`` as {column: key}."""
    found: dict[str, str] = {}
    for part in filter(str.strip, text.split(";")):
        key, colon, columns = part.partition(":")
        names = [c.strip() for c in columns.split(",") if c.strip()]
        if not colon or not key.strip() or not names:
            raise ValueError(f"column keys are 'key: column, column; ...', not {part!r}")
        for c in names:
            if c in found:
                raise ValueError(f"column {c} has two keys")
            found[c] = key.strip()
    return found


def split_options(options: Mapping[str, str] | None) -> tuple[Sealing, dict[str, str]]:
    """What the properties ask to seal here, and the options for the source.

    With a crypto factory the source encrypts by itself and gets them all.
    Columns with keys but neither a factory nor a keystore are an error:
    they would be written in the clear.
    """
    rest = dict(options or {})
    store = rest.pop(KEYSTORE, None)
    if CRYPTO_FACTORY in rest or COLUMN_KEYS not in rest:
        return Sealing(keystore=store), rest
    sealing = Sealing(parse_column_keys(rest.pop(COLUMN_KEYS)), store)
    if sealing and store is None:
        raise KeyUnavailable(f"columns are to be encrypted, but neither {CRYPTO_FACTORY} nor {KEYSTORE} is given")
    return sealing, rest


def create_keystore(spark: SparkSession, path: str, names: Iterable[str], bits: int = 256) -> None:
    """Write fresh random keys under ``names``; an existing store is refused."""
    if bits not in (128, 192, 256):
        raise ValueError("an AES key has 128, 192 or 256 bits")
    made = [(n, base64.b64encode(secrets.token_bytes(bits // 8)).decode()) for n in sorted(set(names))]
    spark.createDataFrame(made, _KEYSTORE_SCHEMA).coalesce(1).write.mode("errorifexists").json(path)


def key_names(spark: SparkSession, keystore: str | None) -> set[str]:
    """The names of the keys at hand; none if there is no keystore to be read."""
    if keystore is None:
        return set()
    try:
        rows = spark.read.schema(_KEYSTORE_SCHEMA).json(keystore).select("name").collect()
    except AnalysisException:
        return set()
    return {r.name for r in rows}


def _subkeys(spark: SparkSession, keystore: str, key: str, column: str) -> Column:
    """Scalar subquery: the subkeys of a column."""
    master = F.hex(F.unbase64("key"))
    derived = F.transform(F.sequence(F.lit(0), F.lit(SUBKEYS - 1)), lambda i: F.unhex(
        F.sha2(F.concat_ws("|", master, F.lit(column), i.cast("string")), 256)))
    return (spark.read.schema(_KEYSTORE_SCHEMA).json(keystore)
            .where(F.col("name") == key).select(derived).scalar())


def sealed_columns(df: DataFrame) -> dict[str, dict[str, str]]:
    """{column: {"key": name, "type": clear type}} of the sealed columns."""
    return {f.name: f.metadata[SEALED] for f in df.schema.fields if SEALED in f.metadata}


def _clear_type(field_: T.StructField) -> str:
    if isinstance(field_.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"column {field_.name} of type {field_.dataType.simpleString()} cannot be sealed")
    return field_.dataType.simpleString()


def seal(df: DataFrame, sealing: Sealing) -> DataFrame:
    """``df`` with the named columns sealed; those it lacks are an error, and
    so is a key that the keystore lacks. Sealed columns stay as they are."""
    spark, done = df.sparkSession, sealed_columns(df)
    unknown = sorted(set(sealing.keys) - set(df.columns))
    if unknown:
        raise ValueError(f"encryption properties name columns not in the data: {unknown}")
    todo = {c: k for c, k in sealing.keys.items() if c not in done}
    if not todo:
        return df
    missing = sorted(set(todo.values()) - key_names(spark, sealing.keystore))
    if missing:
        raise KeyUnavailable(f"keys not in the keystore: {missing}")
    pick = "__subkey"
    while pick in df.columns:
        pick += "_"
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in todo:
            kind = _clear_type(f)
            keys = _subkeys(spark, sealing.keystore, todo[f.name], f.name)
            plain = c if kind == "binary" else c.cast("string").cast("binary")
            cipher = F.aes_encrypt(plain, F.element_at(keys, F.col(pick) + 1), F.lit("GCM"), F.lit("DEFAULT"))
            prefix = F.unhex(F.lpad(F.hex(F.col(pick)), 4, "0"))
            c = F.when(c.isNotNull(), F.concat(prefix, cipher)).alias(
                f.name, metadata={**f.metadata, SEALED: {"key": todo[f.name], "type": kind}})
        out.append(c)
    return df.withColumn(pick, F.floor(F.rand() * SUBKEYS).cast("int")).select(*out)


def unseal(df: DataFrame, keystore: str | None = None) -> DataFrame:
    """``df`` with its sealed columns in the clear where the keystore holds
    their key; cells of the other sealed columns are NULL (masked), of their
    clear type. A cell that was altered does not open and fails the job."""
    spark, sealed = df.sparkSession, sealed_columns(df)
    if not sealed:
        return df
    have = key_names(spark, keystore)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in sealed:
            kind, key = sealed[f.name]["type"], sealed[f.name]["key"]
            rest = {k: v for k, v in f.metadata.items() if k != SEALED}
            if key in have:
                pick = F.conv(F.hex(F.substring(c, 1, 2)), 16, 10).cast("int") + 1
                plain = F.aes_decrypt(F.expr(f"substring(`{f.name}`, 3)"), F.element_at(
                    _subkeys(spark, keystore, key, f.name), pick), F.lit("GCM"), F.lit("DEFAULT"))
                c = plain if kind == "binary" else plain.cast("string").cast(kind)
            else:
                c = F.lit(None).cast(kind)
            c = c.alias(f.name, metadata=rest)
        out.append(c)
    return df.select(*out)


def describe(df: DataFrame) -> str:
    """The sealed columns as JSON, for reports."""
    return json.dumps(sealed_columns(df), sort_keys=True)
