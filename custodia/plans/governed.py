"""Governed execution: run a policy-approved SQL text over catalog tables.

The policy decision point is outside this library; it is any callable
``policy(PolicyRequest) -> GovernedPlan | None``. Its SQL text names the
catalog tables; any table whose name contains ``clauses`` is exposed as
the single view ``clauses``, the name policy rewrites refer to.
"""

from __future__ import annotations

import logging
from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.functions.predicates import any_present
from custodia.model import GovernedPlan, PolicyRequest, TableSpec, Zone
from custodia.operators.export import public_export
from custodia.operators.privacy import mask_by_clauses
from custodia.operators.rows import drop_denied_rows
from custodia.operators.skew import DEFAULT_SKEW, SkewPolicy
from custodia.plans.lineage import column_sources, confine, only_reads
from custodia.sources.catalog import Catalog

log = logging.getLogger(__name__)

CLAUSES_VIEW = "clauses"

Policy = Callable[[PolicyRequest], "GovernedPlan | None"]


def _view_name(table: str) -> str:
    return CLAUSES_VIEW if CLAUSES_VIEW in table else table


def _child(spark: SparkSession) -> SparkSession:
    """A session with its own views and the caller's runtime settings, so a
    plan means the same there (time zone, ANSI mode, partitions)."""
    session = spark.newSession()
    inherited = spark.conf.getAll
    for key, value in inherited.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    # a path in the text is no way around the list of tables
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    return session


def decide(policy: Policy, query: str, purpose: str, access: str,
           requester_id: str = "") -> GovernedPlan:
    """The policy's decision on a request; no decision is a PermissionError,
    raised before anything is read or written."""
    if not purpose:
        raise ValueError("a purpose is required")
    plan = policy(PolicyRequest(query=query, purpose=purpose, access=access,
                                requester_id=requester_id))
    if plan is None:
        raise PermissionError("no policy decision: nothing is read or written")
    return plan


def governed_export(tests: DataFrame, profiles: DataFrame, clauses: DataFrame,
                    plan: GovernedPlan, key: str = "patientId", skew: SkewPolicy | None = DEFAULT_SKEW,
                    **arguments) -> DataFrame:
    """``public_export`` of what the plan's consent rules leave.

    Cells a subject has not consented to share are blanked in both tables
    before anything else sees them: a denied cell takes no part in the
    caller's ``where``, in the category filter or in the cohort. A row of the
    export in which no column but ``stroke`` and the subject id holds a value
    is dropped. A rule for a column that neither table has is an error.
    """
    unknown = [c for c in plan.rules if c not in tests.columns + profiles.columns]
    if unknown:
        raise ValueError(f"rules name columns not in the data: {unknown}")
    masked = [mask_by_clauses(df, clauses, rules, key, skew) if rules else df
              for df in (tests, profiles)
              for rules in [{c: r for c, r in plan.rules.items() if c in df.columns}]]
    export = public_export(*masked, key=key, skew=skew, **arguments)
    return export.where(any_present(c for c in export.columns if c not in ("stroke", key)))


def _granted(spark: SparkSession, plan: GovernedPlan | None, catalog: Catalog,
             args: Mapping[str, object] | None) -> tuple[DataFrame, list[str]]:
    """The result of a plan's text over its tables alone, and their views."""
    if plan is None:
        raise PermissionError("no policy decision: nothing is read")
    views = [_view_name(t) for t in plan.tables]
    if views.count(CLAUSES_VIEW) > 1:
        raise ValueError("a governed plan may reference one clauses table")
    session = _child(spark)
    only_reads(session, plan.sql)
    granted = {}
    for table, view in zip(plan.tables, views):
        # The plan's properties (Parquet decryption keys) are for file
        # sources; a JDBC connection does not get them.
        spec = catalog.spec(table)
        is_jdbc = isinstance(spec, TableSpec) and spec.format == "jdbc"
        options = {} if is_jdbc else dict(plan.write_options)
        granted[view] = catalog.load(session, table, **options)
        granted[view].createOrReplaceTempView(view)
    return confine(session.sql(plan.sql, args=dict(args) if args else None), granted), views


def run_governed(spark: SparkSession, plan: GovernedPlan | None, catalog: Catalog,
                 args: Mapping[str, object] | None = None,
                 subject: str | None = "patientId") -> DataFrame:
    """Run a governed plan and drop the rows policy left empty.

    Views are registered in a private child session (shared SparkContext,
    separate temp-view namespace), so concurrent plans never see each
    other's tables. Query parameters are bound by Spark (``args``), never
    spliced into the text. Nothing runs until the caller acts on the result.

    The list of tables binds, before any job: a text that is no query and a
    table of the session's catalog that the plan does not name are a
    PermissionError; a file named by its path is no table at all here.
    """
    result, _ = _granted(spark, plan, catalog, args)
    return drop_denied_rows(result, subject=subject)


def governed_lineage(spark: SparkSession, plan: GovernedPlan | None, catalog: Catalog,
                     args: Mapping[str, object] | None = None,
                     subject: str | None = "patientId") -> DataFrame:
    """What a governed plan lets out: (column, source_table, source_column,
    cells), a row per result column and column of a granted table that it is
    computed from, with the values of the result column that are not NULL.

    The sources come from the analysed plan (no job), the counts from one
    pass over the result."""
    df, views = _granted(spark, plan, catalog, args)
    named = dict(zip(views, plan.tables))
    result = drop_denied_rows(df, subject=subject)
    counts = result.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(result.columns)))
    per_column = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("cells"))
                                     for k, c in enumerate(result.columns)))).alias("x")
    sources = [(c, named[v], s) for c, v, s in column_sources(df, views)]
    origin = df.sparkSession.createDataFrame(sources, "column string, source_table string, source_column string")
    return (counts.select(per_column).select("x.*").join(F.broadcast(origin), "column")
            .select("column", "source_table", "source_column", "cells"))


def governed_query(spark: SparkSession, query: str, purpose: str, policy: Policy,
                   catalog: Catalog, zone: Zone | str = Zone.ON_PREM,
                   args: Mapping[str, object] | None = None, requester_id: str = "",
                   subject: str | None = "patientId") -> DataFrame:
    """Ask the policy for a decision on ``query`` and run it (query service).

    After the policy's denied rows are dropped (subject id ignored), rows
    with no value at all are dropped too, so an id-only result hides a
    NULL id here, while a movement (``stage_governed``) keeps it.
    """
    if not query:
        raise ValueError("a query is required")
    plan = decide(policy, query, purpose, Zone.parse(zone).access, requester_id)
    log.info("governed query for purpose %s: %s", purpose, plan.sql)
    result = run_governed(spark, plan, catalog, args=args, subject=subject)
    return drop_denied_rows(result, subject=None)
