"""Row-level operators: denied-row removal and JSON row encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.functions.predicates import any_present


def drop_denied_rows(df: DataFrame, subject: str | None = "patientId") -> DataFrame:
    """Drop rows that policy masking left empty.

    With ``subject`` set, a row survives when some column other than the
    subject id is non-NULL; a result made only of the subject column keeps
    every row, NULL ids included. With ``subject=None`` a row survives when
    any column is non-NULL. NaN is a value, not a gap.
    """
    cols = df.columns
    if subject is not None and cols == [subject]:
        return df
    cond = any_present(c for c in cols if c != subject)
    return df if cond is None else df.where(cond)


def to_json_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object text per row; NULL fields are omitted, an all-NULL
    row becomes ``{}``."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(column))


def json_component(df: DataFrame, field: str, dtype: str = "double",
                   column: str = "value") -> DataFrame:
    """Read one field out of JSON row texts as a typed column.

    Malformed or non-numeric text becomes NULL (``try_cast``) instead of
    failing the whole job under ANSI mode.
    """
    raw = df.select(F.json_tuple(F.col(column), field).alias(field))
    return raw.select(F.col(field).try_cast(dtype).alias(field))


def to_variant_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """One VARIANT object per row: typed values instead of a text. Unlike in
    ``to_json_rows``, a NULL field stays as a null of the object."""
    return df.select(F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(column))


def parse_variant_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON row texts as VARIANT, parsed once; a text that is no JSON is NULL
    instead of an error. Other columns stay."""
    return df.withColumn(column, F.try_parse_json(F.col(f"`{column}`")))


def variant_component(df: DataFrame, field: str, dtype: str = "double", column: str = "value") -> DataFrame:
    """One field of VARIANT rows as a typed column. A missing field and one
    that does not fit the type are NULL."""
    name = field.replace("\\", "\\\\").replace("'", "\\'")
    return df.select(F.try_variant_get(F.col(f"`{column}`"), f"$['{name}']", dtype).alias(field))
