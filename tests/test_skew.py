"""The salted join must equal the plain join, with a key holding a third
of all rows."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.operators import SkewPolicy, find_hot_keys, salted_join

HOT = SkewPolicy(buckets=4, max_hot=8, rows_per_task=50)


@pytest.fixture(scope="module")
def fact(spark):
    # 900 rows: key 7 holds 300 (a third), keys 0..59 share the rest, plus NULL keys.
    base = spark.range(900).select(
        F.col("id").alias("rowId"),
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.col("id") % 60).cast("long").alias("k"),
        (F.col("id") * 0.5).alias("v"))
    return base


@pytest.fixture(scope="module")
def keyed(spark):
    # unique keys 0..39 (so some fact keys have no partner) with a payload
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("payload"))


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_probe_finds_the_hot_key(fact):
    assert find_hot_keys(fact, "k", HOT) == {7: 4}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_equals_plain(fact, keyed, how):
    plain = fact.join(keyed, "k", how)
    salted = salted_join(fact, keyed, "k", how, HOT)
    assert salted.columns == plain.columns
    assert _rows(salted) == _rows(plain)


def test_hot_key_is_spread_over_salts(fact, keyed):
    hot = salted_join(fact, keyed, "k", "inner", HOT)
    assert "_salt" in plan_text(hot)
    # no key is hot under the default policy at this size: plain join plan
    plain = salted_join(fact, keyed, "k", "inner")
    assert "_salt" not in plan_text(plain)


def test_superset_hot_list_is_still_exact(fact, keyed):
    salted = salted_join(fact, keyed, "k", "inner", HOT, hot={7: 4, 1: 2, 2: 8, 3: 3, 999: 16})
    assert _rows(salted) == _rows(fact.join(keyed, "k", "inner"))


def test_hot_key_lands_in_several_tasks_of_a_shuffle_join(spark, fact, keyed):
    """With broadcasts off (as for a large per-key side), the hot key's rows
    are split over several reduce tasks instead of one."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    # toy data: keep AQE from merging all reduce partitions into one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        def tasks_for_hot(df):
            return (df.where(F.col("k") == 7).select(F.spark_partition_id().alias("p"))
                    .distinct().count())
        assert tasks_for_hot(fact.join(keyed, "k", "inner")) == 1
        salted = salted_join(fact, keyed, "k", "inner", HOT)
        assert "SortMergeJoin" in plan_text(salted) or "ShuffledHashJoin" in plan_text(salted)
        assert tasks_for_hot(salted) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        if old_aqe is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old_aqe)


def test_salts_grow_with_the_key():
    p = SkewPolicy(rows_per_task=100, max_buckets=1024)
    assert p.salts_for(100) == 2 and p.salts_for(300) == 4 and p.salts_for(1000) == 16
    assert p.salts_for(10**12) == 1024
    assert SkewPolicy(buckets=5).salts_for(10**9) == 5


def test_adaptive_salts_are_exact(fact, keyed):
    adaptive = SkewPolicy(rows_per_task=40, max_hot=8)
    hot = find_hot_keys(fact, "k", adaptive)
    assert hot[7] == 8  # 300 rows / 40 per task -> 8 salts
    assert _rows(salted_join(fact, keyed, "k", "left", adaptive)) == \
        _rows(fact.join(keyed, "k", "left"))


@pytest.fixture
def shuffled(spark):
    """Shuffle joins into 8 partitions that stay apart, as for large sides."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _largest_task(df, condition):
    sizes = df.where(condition).groupBy(F.spark_partition_id().alias("p")).count()
    return max(r["count"] for r in sizes.collect())


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_null_keys_are_spread(spark, shuffled, keyed, how):
    fact = spark.range(0, 4000, 1, 8).select(
        "id", F.when(F.col("id") % 2 == 0, F.col("id") % 40).alias("k"))
    out = salted_join(fact, keyed, "k", how, SkewPolicy(buckets=8, rows_per_task=100))
    assert out.where(F.col("k").isNull()).count() == 2000
    assert _largest_task(out, F.col("k").isNull()) < 1000
    assert _rows(out) == _rows(fact.join(keyed, "k", how))


def test_equal_rows_of_a_hot_key_are_spread(spark, shuffled, keyed):
    fact = spark.range(0, 4000, 1, 16).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 40).cast("long").alias("k"),
        F.lit(1).alias("v"))
    out = salted_join(fact, keyed, "k", "inner", SkewPolicy(buckets=16, rows_per_task=1000))
    assert _largest_task(out, F.col("k") == 7) < 1500
    assert _rows(out) == _rows(fact.join(keyed, "k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_map_columns_are_carried(spark, fact, keyed, how):
    mapped = fact.withColumn("m", F.create_map(F.lit("a"), F.col("v"))) \
        .withColumn("n", F.array(F.struct(F.col("m").alias("x"))))
    salted = salted_join(mapped, keyed, "k", how, HOT)
    assert "_salt" in plan_text(salted)
    assert _rows(salted) == _rows(mapped.join(keyed, "k", how))


def test_every_key_above_the_share_is_hot(spark):
    fact = spark.range(6000).select((F.col("id") % 3000).alias("k"))
    assert len(find_hot_keys(fact, "k", SkewPolicy(rows_per_task=2, max_hot=3000))) == 3000
    assert find_hot_keys(fact, "k", SkewPolicy(rows_per_task=2, max_hot=2999)) == {}
    assert find_hot_keys(fact.limit(0), "k", SkewPolicy(rows_per_task=1)) == {}
