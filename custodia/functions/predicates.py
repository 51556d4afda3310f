"""Row predicates: denied-row detection and birth-year bands."""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_present(columns: Iterable[str]) -> Column | None:
    """TRUE when at least one of the columns is non-NULL.

    NaN counts as a value (unlike ``na.drop``). Returns None for an empty
    list. An OR of IS NOT NULL reaches the Parquet reader as a pushed filter.
    """
    tests = [F.col(c).isNotNull() for c in columns]
    if not tests:
        return None
    return reduce(lambda a, b: a | b, tests)


def years_before(as_of: _dt.date | None, years: int) -> int:
    """Calendar year ``years`` before ``as_of`` (today when None)."""
    as_of = as_of or _dt.date.today()
    return as_of.year - years


def birth_year(column: str) -> Column:
    """Birth year (INT) of a date, timestamp or ISO date text; a text that is
    no date gives NULL instead of failing the job."""
    return F.year(F.col(column).try_cast("date")).cast("int")


def birth_year_filter(df: DataFrame, column: str, min_year: int, max_year: int,
                      lower: str | None = None, upper: str = "exclusive") -> Column:
    """Birth years in a band, typed by the column's storage.

    The reference compares ``birthDate > "min" AND birthDate < "max"``.
    On a date or ISO date text that means ``min <= year < max``; on a stored
    year (the public zone) it means ``min < year < max``. ``lower`` defaults
    accordingly and can be forced to ``inclusive`` or ``exclusive``.

    Date columns are compared with date literals, so the filter is pushed to
    the Parquet scan instead of evaluating ``year()`` on every row. Text is
    compared with the years as texts, which is pushed as well, and the rows
    left must hold a date whose year is in the band.
    """
    dtype = df.schema[column].dataType
    is_year = isinstance(dtype, T.IntegralType)
    if lower is None:
        lower = "exclusive" if is_year else "inclusive"
    lo_incl = lower == "inclusive"
    hi_incl = upper == "inclusive"
    col = F.col(column)
    if is_year:
        lo = col >= min_year if lo_incl else col > min_year
        hi = col <= max_year if hi_incl else col < max_year
        return lo & hi
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        first = _dt.date(min_year if lo_incl else min_year + 1, 1, 1)
        after = _dt.date(max_year + 1 if hi_incl else max_year, 1, 1)
        return (col >= F.lit(first)) & (col < F.lit(after))
    first = min_year if lo_incl else min_year + 1
    after = max_year + 1 if hi_incl else max_year
    year = birth_year(column)
    return ((col >= f"{first:04d}") & (col < f"{after:04d}")
            & (year >= first) & (year < after))
