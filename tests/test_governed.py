import json

import pytest

from custodia.model import GovernedPlan, PolicyRequest, TableSpec, Zone
from custodia.plans import governed_query, run_governed
from custodia.sources.catalog import Catalog
from custodia.sources.fixtures import fixture_catalog

from conftest import SF001


def _catalog(spark, scratch):
    spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "patientId long, v double") \
        .write.parquet(f"{scratch}/m")
    spark.createDataFrame([(1, True), (3, False)], "patientId long, ok boolean") \
        .write.parquet(f"{scratch}/c")
    return Catalog({
        "measures": TableSpec("measures", "s3a", f"{scratch}/m"),
        "measures_clauses": TableSpec("measures_clauses", "parquet", f"{scratch}/c"),
    })


SQL = ("SELECT measures.patientId, CASE WHEN clauses.ok THEN measures.v END AS v "
       "FROM measures LEFT JOIN clauses ON measures.patientId = clauses.patientId "
       "WHERE measures.patientId >= :min_id")


def test_run_governed_masks_and_drops(spark, scratch):
    cat = _catalog(spark, scratch)
    plan = GovernedPlan(SQL, ("measures", "measures_clauses"))
    rows = run_governed(spark, plan, cat, args={"min_id": 1}).collect()
    assert [(r.patientId, r.v) for r in rows] == [(1, 5.0)]
    # the views live in a private session, not the caller's
    assert not spark.catalog.tableExists("clauses")


def test_no_decision_reads_nothing(spark, scratch):
    with pytest.raises(PermissionError):
        run_governed(spark, None, _catalog(spark, scratch))


def test_two_clauses_tables_rejected(spark, scratch):
    cat = _catalog(spark, scratch).register("other_clauses", TableSpec("o", "parquet", f"{scratch}/c"))
    with pytest.raises(ValueError):
        run_governed(spark, GovernedPlan(SQL, ("measures", "measures_clauses", "other_clauses")), cat)


def test_unknown_table_is_an_error(spark, scratch):
    with pytest.raises(KeyError):
        run_governed(spark, GovernedPlan("SELECT 1", ("nope",)), _catalog(spark, scratch))


def test_plan_from_policy_json():
    doc = json.dumps({"rewrittenQuery": "SELECT 1", "tables": [{"name": "a"}, {"name": "b"}],
                      "encryptionProperties": [{"key": "k", "value": "v"}]})
    plan = GovernedPlan.from_json(doc)
    assert plan.tables == ("a", "b") and dict(plan.write_options) == {"k": "v"}
    with pytest.raises(PermissionError):
        GovernedPlan.from_json("{}")


def test_governed_query_calls_policy_with_zone_access(spark):
    seen = []

    def policy(req: PolicyRequest):
        seen.append(req)
        return GovernedPlan("SELECT patientId, socialId FROM patientsProfiles", ("patientsProfiles",))

    df = governed_query(spark, "SELECT ...", "research", policy, fixture_catalog(SF001),
                        zone=Zone.PUBLIC)
    assert df.count() == 150
    assert seen[0].access == "read_public_cloud" and seen[0].purpose == "research"
    with pytest.raises(ValueError):
        governed_query(spark, "q", "", policy, fixture_catalog(SF001))


def test_zone_parse_defaults():
    assert Zone.parse("public") is Zone.PUBLIC
    assert Zone.parse("mars") is Zone.ON_PREM and Zone.parse(None) is Zone.ON_PREM


def test_id_only_null_is_hidden_by_queries_but_moved(spark, scratch):
    from custodia.plans import stage_governed

    spark.createDataFrame([(1,), (None,)], "patientId long").write.parquet(f"{scratch}/ids")
    cat = Catalog({"ids": TableSpec("ids", "parquet", f"{scratch}/ids")})
    plan = GovernedPlan("SELECT patientId FROM ids", ("ids",))
    queried = governed_query(spark, "SELECT patientId FROM ids", "care", lambda r: plan, cat)
    assert [r.patientId for r in queried.collect()] == [1]
    assert stage_governed(spark, plan, cat, f"{scratch}/staged").rows == 2


def test_governed_plan_runs_with_the_callers_settings(spark):
    from custodia.plans.governed import _child

    caller = spark.newSession()
    for key, value in (("spark.sql.session.timeZone", "America/New_York"),
                       ("spark.sql.shuffle.partitions", "77"), ("spark.sql.ansi.enabled", "false")):
        caller.conf.set(key, value)
    child = _child(caller)
    assert child.conf.get("spark.sql.session.timeZone") == "America/New_York"
    assert child.conf.get("spark.sql.shuffle.partitions") == "77"
    assert child.conf.get("spark.sql.ansi.enabled") == "false"
