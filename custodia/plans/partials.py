"""Averages from stored partial sums, kept up to date movement by movement.

For each movement into a zone the store holds one row per component and birth
year: how many values there are and their sum. A movement that arrives adds
its rows, one that is run again replaces them, one that is emptied takes them
away; only that movement's rows are read for it. The average over an age band
then reads a few rows per movement and no measurement.

The store is a movement's target itself: its rows are staged, verified and
published like any other (``plans.movement``), so it never shows half an
update. Sums are doubles, so an average agrees with the one over all rows up
to the order of summation.
"""

from __future__ import annotations

import uuid
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions.columns import COMPONENTS, component_column
from custodia.functions.predicates import birth_year
from custodia.plans.movement import MOVEMENT_COLUMN, MovementReport, finish_movement, start_movement


def partial_sums(rows: DataFrame, components: Iterable[str] = COMPONENTS, birth: str = "birthDate") -> DataFrame:
    """(component, birth_year, n, total): values and their sum per component
    and birth year (NULL is a year of its own), without empty rows. One pass,
    combined before the shuffle; a row per birth year comes out of it."""
    names = [c for c in components if component_column(c) in rows.columns]
    if not names:
        raise ValueError("the rows hold no component")
    values = [F.col(component_column(c)) for c in names]
    # the public zone holds years, the others dates
    stored_year = isinstance(rows.schema[birth].dataType, T.IntegralType)
    year = F.col(birth).cast("int") if stored_year else birth_year(birth)
    sums = rows.groupBy(year.alias("birth_year")).agg(
        *(a.alias(f"{kind}{k}") for k, v in enumerate(values) for kind, a in (("n", F.count(v)), ("t", F.sum(v)))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"n{k}").alias("n"), F.col(f"t{k}").alias("total"))
                               for k, c in enumerate(names))))
    return (sums.select("birth_year", each.alias("p")).select("p.component", "birth_year", "p.n", "p.total")
            .where("n > 0"))


def update_partials(spark: SparkSession, rows: DataFrame, store: str, movement_id: str, staging: str,
                    birth: str = "birthDate") -> MovementReport:
    """Put the partial sums of a movement's rows into the store, in place of
    those of an earlier run of it. No rows: its sums go."""
    start_movement(partial_sums(rows, birth=birth), staging)
    return finish_movement(spark, staging, store, movement_id=movement_id, fill={})


def finish_with_partials(spark: SparkSession, staging: str, target: str, store: str, movement_id: str,
                         birth: str = "birthDate", **arguments) -> MovementReport:
    """``finish_movement`` and the update of the store from the rows that are
    then in the target (after fills). Run again, it repairs a store that a
    lost driver left behind."""
    report = finish_movement(spark, staging, target, movement_id=movement_id, **arguments)
    moved = (spark.read.parquet(target).where(F.col(MOVEMENT_COLUMN).cast("string") == movement_id)
             if not report.empty else spark.read.parquet(staging))
    update_partials(spark, moved, store, movement_id, f"{store}-staging-{uuid.uuid4().hex}", birth)
    return report


def _band(min_year: int | None, max_year: int | None) -> Column:
    """The birth years between the bounds, as the queries on rows take them."""
    cond = F.lit(True)
    if min_year is not None:
        cond = cond & (F.col("birth_year") > min_year)
    if max_year is not None:
        cond = cond & (F.col("birth_year") < max_year)
    return cond


def stored_averages(spark: SparkSession, store: str, min_year: int | None = None, max_year: int | None = None,
                    components: Iterable[str] | None = None, digits: int | None = None) -> DataFrame:
    """(component, n, value): the average of each component with values, over
    all movements, for births after ``min_year`` and before ``max_year``."""
    rows = spark.read.parquet(store).where(_band(min_year, max_year))
    if components is not None:
        rows = rows.where(F.col("component").isin(list(components)))
    value = F.sum("total") / F.sum("n")
    return rows.groupBy("component").agg(
        F.sum("n").alias("n"), (value if digits is None else F.round(value, digits)).alias("value"))
