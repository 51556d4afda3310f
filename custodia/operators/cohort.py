"""Cohorts of subjects and the joins that use them."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from custodia.functions.predicates import birth_year
from custodia.model import Zone
from custodia.operators.skew import (
    DEFAULT_SKEW, SkewPolicy, find_hot_keys, hot_keys, salted_join,
)


def stroke_cohort(tests: DataFrame, key: str = "patientId", flag: str = "stroke") -> DataFrame:
    """Distinct subject ids with any row flagged ``flag = 1``.

    A NULL id is kept (it matters for NOT IN semantics). The flag filter
    reaches the scan; distinct is combined map-side, so the shuffle carries
    at most one row per id and task.
    """
    return tests.where(F.col(flag) == 1).select(key).distinct()


def subject_stats(tests: DataFrame, counted: Column | None = None, key: str = "patientId",
                  flag: str = "stroke") -> DataFrame:
    """One row per subject id (NULL included): ``_n`` rows matching
    ``counted`` (all rows when None) and ``_in_cohort`` (1 when any row has
    ``flag = 1``). One pass with map-side partial aggregation serves both the
    hot-key probe of a later join and the cohort."""
    n = F.count(F.lit(1)) if counted is None else F.count(F.when(counted, F.lit(1)))
    return tests.groupBy(key).agg(
        n.alias("_n"),
        F.max(F.when(F.col(flag) == 1, F.lit(1)).otherwise(F.lit(0))).alias("_in_cohort"))


def cohort_and_hot_keys(tests: DataFrame, counted: Column | None, key: str,
                        skew: SkewPolicy | None, flag: str = "stroke"):
    """(cohort ids incl. a NULL id if flagged, {hot key: salts} or None).

    Without a skew policy the cohort stays a lazy ``distinct`` of the flagged
    rows. With one, the per-subject statistics are computed once and cut
    from their lineage with a reliable checkpoint (in the shared
    ``spark.checkpoint.dir``; its size grows with subjects, not rows), then
    read by both the probe and the cohort, so the measurement keys are
    scanned once instead of twice (the rows themselves are read by the join
    that follows). The pair can be kept and given to several plans. A cluster session that names no shared
    checkpoint folder gets the same result from a separate probe and a lazy
    cohort (one more narrow scan); no machine-local folder is used.
    """
    if skew is None:
        return stroke_cohort(tests, key, flag), None
    from custodia.session import shared_checkpoint_dir

    if shared_checkpoint_dir(tests.sparkSession) is None:
        counted_rows = tests if counted is None else tests.where(counted)
        return stroke_cohort(tests, key, flag), find_hot_keys(counted_rows, key, skew)
    # The largest per-subject count is observed while the statistics are
    # written, so the hot-key read runs only when some subject is hot.
    seen = Observation("subject_stats")
    stats = (subject_stats(tests, counted, key, flag)
             .observe(seen, F.max(F.col("_n")).alias("max_n"), F.sum("_n").alias("total"))
             .checkpoint(eager=True))
    hot = {}
    if (seen.get["max_n"] or 0) >= skew.rows_per_task:
        hot = hot_keys(stats, key, skew, total=seen.get["total"])
    return stats.where(F.col("_in_cohort") == 1).select(key), hot


def in_cohort(tests: DataFrame, cohort: DataFrame, key: str = "patientId",
              skew: SkewPolicy | None = DEFAULT_SKEW,
              hot: Mapping | None = None) -> DataFrame:
    """Rows whose subject is in the cohort (``key IN (cohort)``); NULL ids
    never match. With the pair of ``cohort_and_hot_keys`` as ``cohort`` and
    ``hot`` the measurements are read twice: for their keys and for the rows."""
    ids = cohort.select(key).where(F.col(key).isNotNull())
    return salted_join(tests, ids, key, "left_semi", skew, hot=hot)


def cohort_has_null(cohort: DataFrame, key: str = "patientId"):
    """Scalar-subquery column: TRUE when the cohort contains a NULL id."""
    return cohort.where(F.col(key).isNull()).exists()


def not_in_cohort(tests: DataFrame, cohort: DataFrame, key: str = "patientId",
                  null_ids: str = "ignore",
                  skew: SkewPolicy | None = DEFAULT_SKEW,
                  hot: Mapping | None = None) -> DataFrame:
    """Rows whose subject is not in the cohort (``hot`` as in ``in_cohort``).

    ``null_ids="ignore"`` (default): NOT EXISTS semantics; NULL ids in the
    cohort are ignored and rows with a NULL id are kept.
    ``null_ids="strict"``: SQL ``NOT IN`` semantics; a NULL in the cohort
    empties the result, and rows with a NULL id are dropped unless the
    cohort is empty. Both conditions are scalar subqueries evaluated once,
    so no null-aware broadcast of the whole id set is needed.
    """
    if null_ids not in ("ignore", "strict"):
        raise ValueError("null_ids must be 'ignore' or 'strict'")
    ids = cohort.select(key).where(F.col(key).isNotNull())
    out = salted_join(tests, ids, key, "left_anti", skew, hot=hot)
    if null_ids == "strict":
        out = out.where(~cohort_has_null(cohort, key)
                        & (F.col(key).isNotNull() | ~cohort.exists()))
    return out


def tests_with_profiles(tests: DataFrame, profiles: DataFrame | None,
                        zone: Zone = Zone.ON_PREM, key: str = "patientId",
                        skew: SkewPolicy | None = DEFAULT_SKEW,
                        hot: Mapping | None = None) -> DataFrame:
    """Measurements joined with the subject's profile (inner, NULL ids drop).

    In the public zone the measurement table is already denormalised, so no
    join is made and ``tests`` is returned as it is. In the private zone the
    birth date is returned as a year.
    """
    zone = Zone.parse(zone)
    if zone is Zone.PUBLIC:
        return tests
    if profiles is None:
        raise ValueError("profiles are required outside the public zone")
    if zone is Zone.PRIVATE and "birthDate" in profiles.columns:
        # generalised once per subject, before the join
        profiles = profiles.withColumn("birthDate", birth_year("birthDate"))
    return salted_join(tests, profiles, key, "inner", skew, hot=hot)
