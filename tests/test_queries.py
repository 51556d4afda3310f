"""The driver's gate, locally: every registered query against its DuckDB
oracle at sf0.01, the smoke entry, and plan properties."""

import pytest

import __spark_entry__ as E
from conftest import SF01, plan_text
from oracle_check import compare, duck

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF01, con)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 36
    assert df.count() > 0


CROSS_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(E._QUERIES))
def test_no_python_and_no_cross_join_in_plans(spark, name):
    text = plan_text(E.queries()[name](spark, SF01))
    assert not any(node in text for node in PYTHON_NODES)
    assert not any(node in text for node in CROSS_NODES)


def test_filters_and_pruning_reach_the_scan(spark):
    text = plan_text(E.queries()["stroke_cohort"](spark, SF01))
    # the flag is derived from event_type and event_id: only those and the
    # key are read, not value/ts/props
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    text = plan_text(E.queries()["documents"](spark, SF01))
    assert "PushedFilters" in text


def test_cohort_joins_are_semi_and_anti(spark):
    assert "LeftSemi" in plan_text(E.queries()["in_cohort"](spark, SF01))
    assert "LeftAnti" in plan_text(E.queries()["not_in_cohort"](spark, SF01))


def _scan_blocks(text: str, table: str) -> list[str]:
    """Detail blocks of the formatted plan that scan ``table``."""
    return [b for b in text.split("\n\n")
            if "Scan parquet" in b and f"{table}.parquet" in b and "ReadSchema" in b]


def test_export_scans_the_measurements_once_with_pruned_columns(spark):
    text = plan_text(E.queries()["public_export"](spark, SF01))
    scans = _scan_blocks(text, "events")
    # the cohort and hot keys come from the checkpointed per-subject pass
    assert len(scans) == 1, scans
    assert ("ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,"
            "event_type:string,value:double>") in scans[0]


def test_age_band_average_aggregates_before_the_join(spark):
    tree = plan_text(E.queries()["avg_age"](spark, SF01)).split("\n\n")[0]
    # the operator tree prints the root first: a HashAggregate below the join
    # is the per-subject partial aggregate of the measurements
    assert tree.index("Join") < tree.rindex("HashAggregate")
