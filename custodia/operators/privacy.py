"""Privacy transforms: pseudonyms, generalisation, suppression, masking."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.predicates import birth_year
from custodia.functions.pseudonyms import pseudonym
from custodia.operators.rows import drop_denied_rows
from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, salted_join


def pseudonymise_id(df: DataFrame, column: str = "socialId", method: str = "sha2",
                    salt: str = "") -> DataFrame:
    """Replace an identifier by its pseudonym (see ``functions.pseudonym``)."""
    return df.withColumn(column, pseudonym(column, method=method, salt=salt))


def generalise_birth_date(df: DataFrame, column: str = "birthDate") -> DataFrame:
    """Replace a birth date (or ISO date text; NULL if it is no date) by its
    year (INT)."""
    return df.withColumn(column, birth_year(column))


def suppress_id(df: DataFrame, column: str = "patientId", value: int = 0) -> DataFrame:
    """Replace a subject id by a constant."""
    return df.withColumn(column, F.lit(value))


def mask_by_clauses(df: DataFrame, clauses: DataFrame, rules: Mapping[str, str | Column],
                    key: str = "patientId",
                    skew: SkewPolicy | None = DEFAULT_SKEW,
                    drop_denied: bool = False, hot: Mapping | None = None) -> DataFrame:
    """Blank cells the subject has not consented to share.

    ``clauses`` holds one row per subject with boolean consent columns;
    ``rules`` maps a governed column of ``df`` to the consent column (or a
    boolean expression over consent columns) that allows it. A cell is kept
    only when its consent is TRUE: FALSE, NULL and a subject without a
    clauses row all give NULL. Masking never turns a NULL into a value.

    ``drop_denied=True`` also removes the rows left empty (as
    ``drop_denied_rows``). Because masking only removes values, rows that are
    already empty are dropped before the consent join (exact, and it shrinks
    the join input); the rest are checked again after masking. ``hot`` gives
    known hot keys, as in ``salted_join``.
    """
    unknown = [c for c in rules if c not in df.columns]
    if unknown:
        raise ValueError(f"rules name columns not in the data: {unknown}")
    conds = {c: (F.col(r) if isinstance(r, str) else r) for c, r in rules.items()}
    needed = sorted({r for r in rules.values() if isinstance(r, str)})
    only_names = all(isinstance(r, str) for r in rules.values())
    consent = clauses.select(key, *needed) if only_names else clauses
    source = drop_denied_rows(df, subject=key) if drop_denied else df
    joined = salted_join(source, consent, key, "left", skew, hot=hot)
    masked = joined.select(*[
        F.when(conds[c], F.col(c)).alias(c) if c in conds else F.col(c)
        for c in df.columns
    ])
    return drop_denied_rows(masked, subject=key) if drop_denied else masked
