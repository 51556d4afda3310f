"""The clinical reads: component series, age-band average, patient
details and documents, nutritional data of the stroke cohort."""

from __future__ import annotations

import datetime as _dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.columns import NUTRITIONAL_COLUMNS, PROFILE_COLUMNS, component_column
from custodia.functions.predicates import birth_year_filter, years_before
from custodia.functions.pseudonyms import pseudonym_of
from custodia.model import Zone
from custodia.operators.cohort import cohort_and_hot_keys
from custodia.operators.privacy import generalise_birth_date
from custodia.operators.rows import drop_denied_rows
from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy, salted_join

log = logging.getLogger(__name__)

BLOOD_TEST = "blood_test"


def component_series(tests: DataFrame, component: str, patient_id=None,
                     measured_only: bool = False, key: str = "patientId",
                     date: str = "date") -> DataFrame:
    """(subject, date, value) rows of one component.

    Like the reference, no subject filter is applied unless ``patient_id``
    is given, and a row stays while its date or value is present;
    ``measured_only`` keeps only rows that carry a value.
    """
    value = component_column(component)
    df = tests.select(key, date, value)
    if patient_id is not None:
        df = df.where(F.col(key) == F.lit(patient_id))
    if measured_only:
        df = df.where(F.col(value).isNotNull())
    return drop_denied_rows(df, subject=key)


def birth_years(start_age: int, end_age: int, as_of: _dt.date | None = None) -> tuple[int, int]:
    """(min_year, max_year) of births for ages in [start_age, end_age]."""
    if start_age >= end_age:
        raise ValueError("start_age must be below end_age")
    return years_before(as_of, end_age), years_before(as_of, start_age)


def age_band_values(tests: DataFrame, profiles: DataFrame | None, component: str,
                    start_age: int, end_age: int, as_of: _dt.date | None = None,
                    zone: Zone = Zone.ON_PREM, key: str = "patientId",
                    birth: str = "birthDate",
                    skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """(value, subject) rows of a component for subjects born in the band.

    Outside the public zone the band filter and projection are applied to
    the profiles before they are joined, so only the band's subjects and
    two columns are shuffled. In the public zone the measurement table
    already carries the birth year and no join is made.
    """
    min_year, max_year = birth_years(start_age, end_age, as_of)
    value = component_column(component)
    if Zone.parse(zone) is Zone.PUBLIC:
        df = tests.where(birth_year_filter(tests, birth, min_year, max_year)).select(value, key)
    else:
        band = profiles.where(birth_year_filter(profiles, birth, min_year, max_year)).select(key)
        facts = tests.select(key, value)
        df = salted_join(facts, band, key, "inner", skew).select(value, key)
    return drop_denied_rows(df, subject=key)


def component_average(values: DataFrame, column: str, digits: int | None = None,
                      alias: str = "value") -> DataFrame:
    """One-row average of a value column (NULL when there are no values).
    Partial averages are combined map-side; nothing is collected."""
    agg = F.avg(F.col(column))
    if digits is not None:
        agg = F.round(agg, digits)
    return values.agg(agg.alias(alias))


def age_band_average(tests: DataFrame, profiles: DataFrame | None, component: str,
                     start_age: int, end_age: int, as_of: _dt.date | None = None,
                     zone: Zone = Zone.ON_PREM, digits: int | None = None,
                     key: str = "patientId", birth: str = "birthDate") -> DataFrame:
    """Average of a component over subjects in an age band (one row,
    ``value``; NULL when no value qualifies).

    Outside the public zone the measurements are first reduced to one
    (sum, count) per subject, combined map-side, so the join with the
    band's subjects moves one row per subject instead of every measurement,
    and a subject with a huge share of the rows costs one partial per task.
    Joining partials and summing them equals the average over the joined
    rows (a subject listed twice in the profiles counts twice, as in the
    row-level join).
    """
    min_year, max_year = birth_years(start_age, end_age, as_of)
    value = component_column(component)
    if Zone.parse(zone) is Zone.PUBLIC:
        values = tests.where(birth_year_filter(tests, birth, min_year, max_year))
        return component_average(values, value, digits=digits)
    if profiles is None:
        raise ValueError("profiles are required outside the public zone")
    partial = (tests.where(F.col(key).isNotNull()).groupBy(key)
               .agg(F.sum(value).alias("_sum"), F.count(value).alias("_cnt")))
    band = profiles.where(birth_year_filter(profiles, birth, min_year, max_year)).select(key)
    avg = F.try_divide(F.sum("_sum"), F.sum("_cnt"))
    if digits is not None:
        avg = F.round(avg, digits)
    return partial.join(band, key, "inner").agg(avg.alias("value"))


def _zone_view(df: DataFrame, zone: Zone, birth: str = "birthDate") -> DataFrame:
    """In the private zone birth dates leave only as years."""
    if Zone.parse(zone) is Zone.PRIVATE and birth in df.columns:
        return generalise_birth_date(df, birth)
    return df


def _require(have: list[str], wanted: tuple[str, ...]) -> None:
    missing = [c for c in wanted if c not in have]
    if missing:
        raise ValueError(f"columns not in the data: {missing}; name those to return in columns")


def patient_details(profiles: DataFrame, social_id: str | None = None,
                    zone: Zone = Zone.ON_PREM, method: str = "sha2", salt: str = "",
                    id_column: str = "socialId", key: str = "patientId",
                    columns: tuple[str, ...] = PROFILE_COLUMNS) -> DataFrame:
    """The profile columns of the details query. A table without some of them
    is an error; name the ones it has in ``columns``.

    With ``social_id`` the rows are those of that person; in the private
    zone the stored id is a pseudonym, the lookup compares pseudonyms and
    the birth date is returned as a year.
    """
    _require(profiles.columns, columns)
    df = profiles.select(*columns)
    if social_id is not None:
        target: Column = (pseudonym_of(social_id, method=method, salt=salt)
                          if Zone.parse(zone) is Zone.PRIVATE else F.lit(social_id))
        df = df.where(F.col(id_column) == target)
    return drop_denied_rows(_zone_view(df, zone), subject=key)


def patient_documents(documents: DataFrame, patient_id, key: str = "patientId") -> DataFrame:
    """All documents of one subject (every column, whole texts).

    Like the reference, this read is not routed through a policy.
    """
    if patient_id is None or patient_id == "":
        raise ValueError("patient_id must be given")
    log.info("ungoverned read of documents for one subject")
    return documents.where(F.col(key) == F.lit(patient_id))


def nutritional_data(tests: DataFrame, profiles: DataFrame | None = None,
                     zone: Zone = Zone.ON_PREM, limit: int | None = None,
                     order_by: str | list[str] | None = None, key: str = "patientId",
                     columns: tuple[str, ...] = NUTRITIONAL_COLUMNS,
                     skew: SkewPolicy | None = DEFAULT_SKEW, flag: str = "stroke",
                     category: str = "category") -> DataFrame:
    """Nutrition-related values of blood-test rows of stroke patients.

    Private/on-prem: the cohort (ids with any stroke row) is applied to the
    profiles first (a semi-join on the small side), then measurements are
    joined to those profiles: one fact join serves both the profile join
    and the cohort. Public zone: the table is denormalised and ``stroke``
    is already per patient, so the cohort is a plain filter.

    A column of ``columns`` that neither table has is an error.
    ``limit`` with ``order_by`` is a top-k (per-task top-k, then merged);
    without ``order_by`` any ``limit`` rows are returned, as in the reference.
    In the private zone the birth date is returned as a year.
    """
    public = Zone.parse(zone) is Zone.PUBLIC
    if not public and profiles is None:
        raise ValueError("profiles are required outside the public zone")
    _require(tests.columns if public else tests.columns + profiles.columns, columns)
    facts = tests.where(F.col(category) == BLOOD_TEST)
    if public:
        df = facts.where(F.col(flag) == 1)
    else:
        cohort, hot = cohort_and_hot_keys(tests, F.col(category) == BLOOD_TEST, key, skew, flag)
        cohort = cohort.where(F.col(key).isNotNull())
        wanted = [c for c in profiles.columns if c in columns and c != key]
        # private zone: birth years are made once per subject, before the join
        patients = _zone_view(profiles.select(key, *wanted), zone).join(cohort, key, "left_semi")
        keep = [c for c in facts.columns if c in columns or c == key
                or (order_by and c in ([order_by] if isinstance(order_by, str) else order_by))]
        df = salted_join(facts.select(*keep), patients, key, "inner", skew, hot=hot)
    if limit is not None:
        if order_by is not None:
            df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
        df = df.limit(limit)
    return drop_denied_rows(df.select(*columns), subject=key)
