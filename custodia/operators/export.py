"""Anonymised, denormalised export of measurements for the public zone."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.columns import MEASUREMENT_COLUMNS
from custodia.functions.predicates import birth_year
from custodia.operators.clinical import BLOOD_TEST
from custodia.operators.cohort import cohort_and_hot_keys, cohort_has_null
from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, salted_join

# Leading columns of the public table, before the 32 measurement columns.
PUBLIC_PREFIX = ("stroke", "patientId", "gender", "birthDate")
PUBLIC_COLUMNS = PUBLIC_PREFIX + MEASUREMENT_COLUMNS


def _as_condition(where: Column | str | None) -> Column | None:
    if where is None or isinstance(where, Column):
        return where
    return F.expr(where)


def _public_projection(df: DataFrame, stroke: Column, key: str, flag: str, gender: str,
                       birth: str, measurements: tuple[str, ...]) -> DataFrame:
    # birth is already a year here (computed per subject, before the join)
    return df.select(
        stroke.cast("int").alias(flag),
        F.lit(0).alias(key),
        F.col(gender),
        F.col(birth),
        *[F.col(c) for c in measurements],
    )


def public_export(tests: DataFrame, profiles: DataFrame, where: Column | str | None = None,
                  distinct: bool = True, null_ids: str = "ignore",
                  plan: str = "one_pass", key: str = "patientId",
                  skew: SkewPolicy | None = DEFAULT_SKEW, flag: str = "stroke",
                  category: str = "category", gender: str = "gender",
                  birth: str = "birthDate",
                  measurements: tuple[str, ...] = MEASUREMENT_COLUMNS,
                  name: str = "blood_tests", limit: int | None = None,
                  order_by: str | Column | list | None = None) -> DataFrame:
    """Blood-test rows for the public zone, de-identified and denormalised.

    Each blood-test row of a profiled subject becomes a 36-column row:
    ``stroke`` (1 when the subject has any stroke row, else 0), ``patientId``
    suppressed to 0, ``gender``, birth year as ``birthDate``, then the 32
    measurement columns. ``where`` (a Column or SQL condition over the
    measurement table) restricts the exported rows, not the cohort; its columns
    may be qualified with ``name``. ``limit`` keeps so many rows of the export,
    the first by ``order_by`` where that is given (a per-task top-k), else any.
    ``distinct=True`` removes duplicate rows, as the reference's UNION does
    (equal measurements of different people collapse once ids are 0).

    ``plan="one_pass"``: the cohort becomes a per-subject flag on the
    profiles (a small left join), then one skew-safe join of measurements
    to flagged profiles. Because the two cohort branches differ in the
    ``stroke`` literal, one ``distinct`` equals the UNION of both.
    ``plan="two_branch"``: the reference's shape, NOT IN and IN branches
    joined separately and unioned (kept for comparison).

    ``null_ids="strict"`` reproduces NOT IN when the cohort holds a NULL
    id: the stroke-0 branch is then empty.

    Column names are arguments (the reference's names by default), so the
    same export runs on other subject/measurement tables.

    The export keeps gender, birth year and exact dates, so small groups
    may stay re-identifiable; see ``quasi_identifier_groups``.
    """
    if null_ids not in ("ignore", "strict"):
        raise ValueError("null_ids must be 'ignore' or 'strict'")
    if plan not in ("one_pass", "two_branch"):
        raise ValueError("plan must be 'one_pass' or 'two_branch'")
    cond = _as_condition(where)
    exported = F.col(category) == BLOOD_TEST
    if cond is not None:
        exported = exported & cond
    facts = tests.alias(name).where(exported).select(key, *measurements)
    # Per-subject values are computed once per subject, not per measurement.
    people = profiles.select(key, gender, birth_year(birth).alias(birth))

    def project(df: DataFrame, stroke: Column) -> DataFrame:
        return _public_projection(df, stroke, key, flag, gender, birth, measurements)

    # One pass over the measurement keys gives the cohort and the hot keys.
    cohort, hot = cohort_and_hot_keys(tests.alias(name), exported, key, skew, flag)
    ids = cohort.where(F.col(key).isNotNull())

    if plan == "one_pass":
        # The flag as semi join (1) plus anti join (0), not a left join:
        # Spark sizes a semi/anti join like its left side but a left join as
        # the product of both sides, so this keeps the per-subject side
        # eligible for a broadcast when it is small, instead of shuffling the
        # measurements first.
        flagged = (people.join(ids, key, "left_semi").withColumn("_stroke", F.lit(1))
                   .unionByName(people.join(ids, key, "left_anti").withColumn("_stroke", F.lit(0))))
        joined = salted_join(facts, flagged, key, "inner", skew, hot=hot)
        out = project(joined, F.col("_stroke"))
        if null_ids == "strict":
            out = out.where((F.col(flag) == 1) | ~cohort_has_null(cohort, key))
    else:
        # The probe of the measurements serves all three joins (results are
        # exact for any hot-key list; with one profile per subject the
        # joined rows per key equal the measurement rows per key).
        joined = salted_join(facts, people, key, "inner", skew, hot=hot)
        branch1 = salted_join(joined, ids, key, "left_semi", skew, hot=hot)
        branch0 = salted_join(joined, ids, key, "left_anti", skew, hot=hot)
        if null_ids == "strict":
            branch0 = branch0.where(~cohort_has_null(cohort, key))
        out = project(branch0, F.lit(0)).unionByName(project(branch1, F.lit(1)))
    if distinct:
        out = out.distinct()
    if limit is not None and order_by is not None:
        out = out.orderBy(*(order_by if isinstance(order_by, list) else [order_by]))
    return out if limit is None else out.limit(limit)


def quasi_identifier_groups(export: DataFrame,
                            columns: Iterable[str] = ("gender", "birthDate")) -> DataFrame:
    """Row count per combination of quasi-identifiers in an export
    (small groups are re-identification risks)."""
    cols = list(columns)
    return export.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
