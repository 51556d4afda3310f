from custodia.operators import in_cohort, not_in_cohort, stroke_cohort, tests_with_profiles
from custodia.model import Zone

ROWS = [(1, 10, 0), (2, 10, 1), (3, 11, 0), (4, 12, 0), (5, None, 0)]


def _tests(spark, rows=ROWS):
    return spark.createDataFrame(rows, "testId long, patientId long, stroke int")


def _ids(df):
    return sorted(r.testId for r in df.collect())


def test_stroke_cohort_distinct(spark):
    t = _tests(spark, ROWS + [(6, 10, 1)])
    assert [r.patientId for r in stroke_cohort(t).collect()] == [10]


def test_in_and_not_in_without_nulls(spark):
    t = _tests(spark)
    cohort = stroke_cohort(t)
    assert _ids(in_cohort(t, cohort)) == [1, 2]
    # NOT EXISTS keeps the NULL-id row; strict NOT IN drops it.
    assert _ids(not_in_cohort(t, cohort)) == [3, 4, 5]
    assert _ids(not_in_cohort(t, cohort, null_ids="strict")) == [3, 4]


def test_not_in_with_null_in_cohort_is_empty_when_strict(spark):
    t = _tests(spark, ROWS + [(7, None, 1)])
    cohort = stroke_cohort(t)
    assert _ids(not_in_cohort(t, cohort, null_ids="strict")) == []
    assert _ids(not_in_cohort(t, cohort)) == [3, 4, 5, 7]
    assert _ids(in_cohort(t, cohort)) == [1, 2]


def test_not_in_empty_cohort_keeps_everything_even_null_ids(spark):
    t = _tests(spark, [(1, 10, 0), (2, None, 0)])
    assert _ids(not_in_cohort(t, stroke_cohort(t), null_ids="strict")) == [1, 2]


def test_matches_sql_not_in(spark):
    t = _tests(spark, ROWS + [(7, None, 1)])
    t.createOrReplaceTempView("t_cohort")
    sql = spark.sql("SELECT testId FROM t_cohort WHERE patientId NOT IN "
                    "(SELECT patientId FROM t_cohort WHERE stroke = 1)")
    assert _ids(sql) == _ids(not_in_cohort(t, stroke_cohort(t), null_ids="strict"))


def test_public_zone_needs_no_join(spark):
    t = _tests(spark)
    assert tests_with_profiles(t, None, zone=Zone.PUBLIC) is t


def test_private_zone_join_returns_birth_years(spark):
    import datetime as dt
    t = _tests(spark)
    p = spark.createDataFrame([(10, dt.date(1970, 5, 1)), (11, dt.date(1980, 1, 1))],
                              "patientId long, birthDate date")
    rows = tests_with_profiles(t, p, zone=Zone.PRIVATE).collect()
    assert sorted(r.birthDate for r in rows) == [1970, 1970, 1980]
    assert {type(r.birthDate) for r in tests_with_profiles(t, p).collect()} == {dt.date}
