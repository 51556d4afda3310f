import pytest
from pyspark.sql import functions as F

from custodia.operators import PUBLIC_COLUMNS, SkewPolicy, public_export, quasi_identifier_groups
from custodia.sources.fixtures import blood_tests, patients_profiles

from conftest import SF01


@pytest.fixture(scope="module")
def tables(spark):
    return blood_tests(spark, SF01), patients_profiles(spark, SF01)


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_export_shape_and_suppressed_ids(tables):
    bt, pp = tables
    out = public_export(bt, pp)
    assert tuple(out.columns) == PUBLIC_COLUMNS and len(out.columns) == 36
    assert out.where(F.col("patientId") != 0).count() == 0
    assert dict(out.dtypes)["birthDate"] == "int"


def test_one_pass_equals_two_branch(tables):
    bt, pp = tables
    a = public_export(bt, pp)
    b = public_export(bt, pp, plan="two_branch", null_ids="strict")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_salted_export_equals_plain(tables):
    bt, pp = tables
    forced = SkewPolicy(buckets=4, max_hot=10_000, rows_per_task=1)
    assert _rows(public_export(bt, pp, skew=forced)) == _rows(public_export(bt, pp, skew=None))


def test_where_restricts_rows_not_the_cohort(tables):
    bt, pp = tables
    out = public_export(bt, pp, where="fibrinogen_value IS NOT NULL")
    assert out.where(F.col("fibrinogen_value").isNull()).count() == 0
    # stroke rows still flagged though the stroke rows themselves may lack fibrinogen
    assert out.where(F.col("stroke") == 1).count() > 0


def _toy(spark, with_null_cohort):
    rows = [(1, 10, "blood_test", 1, 1.0), (2, 11, "blood_test", 0, 2.0),
            (3, 11, "blood_test", 0, 2.0), (4, None, "blood_test", 1, 3.0)]
    if not with_null_cohort:
        rows = rows[:3]
    tests = spark.createDataFrame(rows, "testId long, patientId long, category string, "
                                        "stroke int, fibrinogen_value double")
    from custodia.functions.columns import MEASUREMENT_COLUMNS
    for c in MEASUREMENT_COLUMNS:
        if c not in tests.columns:
            tests = tests.withColumn(c, F.lit(None).cast("string"))
    profiles = spark.sql("SELECT * FROM VALUES (10L, 'f', DATE'1970-01-01'), "
                         "(11L, 'm', DATE'1980-01-01') AS t(patientId, gender, birthDate)")
    return tests, profiles


def test_duplicates_collapse_like_union(spark):
    tests, profiles = _toy(spark, False)
    assert public_export(tests, profiles).count() == 2
    assert public_export(tests, profiles, distinct=False).count() == 3


@pytest.mark.parametrize("plan", ["one_pass", "two_branch"])
def test_null_id_in_cohort_empties_branch_zero_when_strict(spark, plan):
    tests, profiles = _toy(spark, True)
    strict = public_export(tests, profiles, null_ids="strict", plan=plan)
    assert [r.stroke for r in strict.collect()] == [1]
    assert sorted(r.stroke for r in public_export(tests, profiles, plan=plan).collect()) == [0, 1]


def test_group_sizes(tables):
    bt, pp = tables
    groups = quasi_identifier_groups(public_export(bt, pp))
    assert groups.agg(F.sum("n")).first()[0] == public_export(bt, pp).count()


def test_export_without_a_shared_checkpoint_folder(spark, tables, monkeypatch):
    """A cluster session naming no checkpoint folder: same rows, no
    machine-local folder, the probe runs separately."""
    import custodia.session as session

    bt, pp = tables
    forced = SkewPolicy(buckets=4, max_hot=10_000, rows_per_task=1)
    expected = _rows(public_export(bt, pp, skew=None))
    monkeypatch.setattr(session, "shared_checkpoint_dir", lambda s: None)
    assert _rows(public_export(bt, pp, skew=forced)) == expected
    assert _rows(public_export(bt, pp)) == expected


def test_export_on_tables_with_other_column_names(spark):
    tests, profiles = _toy(spark, False)
    renamed_t = (tests.withColumnRenamed("patientId", "subject").withColumnRenamed("stroke", "event")
                 .withColumnRenamed("category", "kind"))
    renamed_p = (profiles.withColumnRenamed("patientId", "subject")
                 .withColumnRenamed("gender", "sex").withColumnRenamed("birthDate", "born"))
    out = public_export(renamed_t, renamed_p, key="subject", flag="event", category="kind",
                        gender="sex", birth="born",
                        measurements=("fibrinogen_value",))
    assert out.columns == ["event", "subject", "sex", "born", "fibrinogen_value"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0, "m", 1980, 2.0), (1, 0, "f", 1970, 1.0)]
