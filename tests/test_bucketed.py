"""Tables laid out by subject: whole results, no exchange, hot keys apart."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.operators import SkewPolicy, mask_by_clauses, tests_with_profiles as with_profiles
from custodia.sources.bucketed import buckets_for, open_bucketed, write_bucketed

HOT = SkewPolicy(rows_per_task=50)


@pytest.fixture(scope="module")
def data(spark):
    tests = spark.range(1000).selectExpr(
        "id AS testId", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id % 90 END AS patientId", "id / 2.0D AS v")
    profiles = spark.range(80).selectExpr("id AS patientId", "concat('n', id) AS name", "id % 2 = 0 AS ok")
    return tests, profiles


@pytest.fixture()
def laid_out(spark, data, scratch):
    tests, profiles = data
    return (write_bucketed(tests, f"{scratch}/tests", "patientId", 8, HOT),
            write_bucketed(profiles, f"{scratch}/profiles", "patientId", 8, skew=None))


def same(a, b):
    return a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_the_parts_are_the_table(spark, data, laid_out):
    tests, _ = laid_out
    assert set(tests.hot) == {7, None} and same(tests.read(spark), data[0])
    assert tests.cold(spark).where("patientId = 7 OR patientId IS NULL").isEmpty()
    again = open_bucketed(spark, tests.folder)
    assert again == tests and same(again.read(spark.newSession()), data[0])


def test_joins_of_buckets_move_nothing(spark, data, laid_out):
    tests, profiles = laid_out
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_profiles(tests.cold(spark), profiles.cold(spark), skew=None)
        text = plan_text(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text and "SelectedBucketsCount: 8 out of 8" in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_operators_over_parts(spark, data, laid_out):
    tests, profiles = laid_out
    keyed = profiles.read(spark)
    got = tests.over_parts(spark, lambda rows, skew, hot: with_profiles(rows, keyed, skew=skew, hot=hot), HOT)
    assert same(got.select(sorted(got.columns)), data[0].join(data[1], "patientId").select(sorted(got.columns)))
    rules = {"v": "ok"}
    got = tests.over_parts(spark, lambda rows, skew, hot: mask_by_clauses(rows, keyed, rules, skew=skew, hot=hot), HOT)
    assert same(got, mask_by_clauses(data[0], data[1], rules).select(got.columns))


def test_layouts_without_hot_keys_without_rows_and_in_use(spark, data, scratch):
    plain = write_bucketed(data[0], f"{scratch}/a", "patientId", 3)
    assert not plain.hot and plain.beside(spark) is None and same(plain.read(spark), data[0])
    none = write_bucketed(data[0].limit(0), f"{scratch}/b", "patientId", 3)
    assert none.read(spark).isEmpty()
    clash = data[0].withColumn("odd name", F.lit("x")).withColumnRenamed("patientId", "odd key")
    odd = write_bucketed(clash, f"{scratch}/it's", "odd key", 2, HOT)
    assert same(odd.read(spark), clash)
    with pytest.raises(FileExistsError):
        write_bucketed(data[0], f"{scratch}/a", "patientId", 3)
    with pytest.raises(FileNotFoundError):
        open_bucketed(spark, f"{scratch}/nothing")
    for key, buckets in (("lost", 3), ("patientId", 0)):
        with pytest.raises(ValueError):
            write_bucketed(data[0], f"{scratch}/c", key, buckets)
    assert [buckets_for(b, 100) for b in (0, 100, 101, 10**9)] == [1, 1, 2, 100_000]
