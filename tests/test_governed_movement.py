"""Movements under a policy: consent holds before anything is staged."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from custodia.model import GovernedPlan
from custodia.operators import in_cohort, public_export, stroke_cohort
from custodia.plans import finish_governed, governed_export, stage_governed_export, start_movement
from custodia.sources.fixtures import fixture_catalog

from conftest import SF001

PURPOSE = "data_movement_public_cloud"


def test_a_denied_cell_never_reaches_staging(spark, scratch):
    catalog = fixture_catalog(SF001)
    stage_governed_export(spark, catalog, f"{scratch}/s", PURPOSE, E.export_policy, distinct=False)
    staged = spark.read.parquet(f"{scratch}/s")
    tests, clauses = catalog.load(spark, "blood_tests"), catalog.load(spark, "blood_tests_clauses")
    profiles = catalog.load(spark, "patientsProfiles")
    allowed = in_cohort(tests, clauses.where("consent_labs")).where("category = 'blood_test'")
    allowed = allowed.join(profiles, "patientId", "left_semi")
    for column in ("fibrinogen_value", "cholesterol_total_value"):
        assert (staged.where(F.col(column).isNotNull()).count()
                == allowed.where(F.col(column).isNotNull()).count()), column


def test_a_refused_policy_stages_and_writes_nothing(spark, scratch):
    catalog = fixture_catalog(SF001)
    with pytest.raises(PermissionError):
        stage_governed_export(spark, catalog, f"{scratch}/s", "marketing", E.export_policy)
    with pytest.raises(ValueError):
        stage_governed_export(spark, catalog, f"{scratch}/s", "", E.export_policy)
    assert not os.path.exists(f"{scratch}/s")
    start_movement(spark.range(3), f"{scratch}/s")
    asked = []

    def reads_only(request):
        asked.append((request.access, request.query))

    with pytest.raises(PermissionError):
        finish_governed(spark, f"{scratch}/s", f"{scratch}/t", PURPOSE, reads_only)
    assert asked == [("write", f"{scratch}/t")] and not os.path.exists(f"{scratch}/t")


def test_denied_cells_take_no_part_in_filter_and_cohort(spark):
    tests = spark.createDataFrame(
        [(1, "blood_test", 1, 5.0), (2, "blood_test", 1, 6.0), (2, "blood_test", 0, None)],
        "patientId long, category string, stroke int, fibrinogen_value double")
    profiles = spark.createDataFrame([(1, "f", "1970-01-01"), (2, "m", "bad")],
                                     "patientId long, gender string, birthDate string")
    clauses = spark.createDataFrame([(1, True), (2, False)], "patientId long, ok boolean")
    plan = GovernedPlan("", (), rules={"stroke": "ok", "fibrinogen_value": "ok", "gender": "ok"})

    def rows(**kw):
        out = governed_export(tests, profiles, clauses, plan,
                              measurements=("category", "fibrinogen_value"), **kw)
        return sorted(map(tuple, out.collect()), key=repr)

    mine, other = (1, 0, "f", 1970, "blood_test", 5.0), (0, 0, None, None, "blood_test", None)
    assert rows() == [other, mine]
    assert rows(where="blood_tests.fibrinogen_value > 1") == [mine]
    with pytest.raises(ValueError):
        governed_export(tests, profiles, clauses, GovernedPlan("", (), rules={"nowhere": "ok"}))


def test_export_limit_and_order(spark):
    catalog = fixture_catalog(SF001)
    tests, profiles = catalog.load(spark, "blood_tests"), catalog.load(spark, "patientsProfiles")
    whole = public_export(tests, profiles)
    first = public_export(tests, profiles, limit=3, order_by=[F.col("date").desc(), "birthDate"])
    assert [r.date for r in first.collect()] == [
        r.date for r in whole.orderBy(F.col("date").desc(), "birthDate").limit(3).collect()]
    assert public_export(tests, profiles, limit=0).count() == 0


def test_public_zone_reads_have_no_join(spark):
    from conftest import plan_text

    for name in ("public_cohort", "public_avg_age", "birth_year_int", "public_group_sizes", "public_tests"):
        assert "Join" not in plan_text(E.queries()[name](spark, SF001)), name


def test_cohort_queries_read_the_measurements_twice(spark):
    from conftest import plan_text

    text = plan_text(E.queries()["not_in_cohort"](spark, SF001))
    assert text.split("== Physical Plan ==")[1].split("\n\n")[0].count("Scan parquet") == 1
    assert stroke_cohort(fixture_catalog(SF001).load(spark, "blood_tests")).columns == ["patientId"]
