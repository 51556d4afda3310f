"""Bitmap cohorts against sets."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.operators import SkewPolicy
from custodia.operators.bitmaps import Cohort, cohort_ids, cohort_index, cohort_size, members, rows_in

NAMES = "abc"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    ids = [0, 1, 2, -1, -5, 8, 9, 32768, 32769, -32768, -32769, 65536, 2**40, -2**40, 2**62, -2**62] + list(range(100, 160))
    rows = [(rng.choice(ids), *(rng.random() < p for p in (0.2, 0.5, 0.05))) for _ in range(400)]
    rows = [(i, *(None if rng.random() < 0.1 else f for f in fs)) for i, *fs in rows]
    return rows + [(None, True, True, True), (None, None, False, True)]


@pytest.fixture(scope="module")
def sets(data):
    everybody = {i for i, *_ in data if i is not None}
    return everybody, {n: {r[0] for r in data if r[k + 1] and r[0] is not None} for k, n in enumerate(NAMES)}


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    df = spark.createDataFrame(data, "patientId long, a boolean, b boolean, c boolean")
    cohort_index(df, {n: n for n in NAMES}).write.parquet(path)
    return spark.read.parquet(path)


def formulas():
    leaf = st.sampled_from(NAMES).map(lambda n: (n, Cohort.named(n)))
    return st.recursive(leaf, lambda part: st.one_of(
        part.map(lambda x: (f"(E-{x[0]})", ~x[1])),
        st.tuples(part, part, st.sampled_from("&|-")).map(
            lambda x: (f"({x[0][0]}{x[2]}{x[1][0]})",
                       x[0][1] & x[1][1] if x[2] == "&" else x[0][1] | x[1][1] if x[2] == "|" else x[0][1] - x[1][1]))),
        max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(formula=formulas())
def test_formulas_equal_set_algebra(index, sets, formula):
    text, cohort = formula
    want = eval(text, {"E": sets[0], **sets[1]})
    bitmap = members(index, cohort)
    assert sorted(r.patientId for r in cohort_ids(bitmap).collect()) == sorted(want)


def test_sizes_rows_and_plans(spark, index, sets, data):
    everybody, cohorts = sets
    a, b, c = map(Cohort.named, NAMES)
    for cohort, want in ((a, cohorts["a"]), (a & ~a, set()), (a | ~a, everybody), ((a | b) - c, (cohorts["a"] | cohorts["b"]) - cohorts["c"])):
        assert cohort_size(members(index, cohort)).first().n == len(want)
    bitmap = members(index, (a | b) - c)
    assert plan_text(bitmap, "simple").count("FileScan") == 1
    rows = spark.createDataFrame([(r[0], k) for k, r in enumerate(data)] + [(77777, -1)], "patientId long, bits int") \
        .withColumn("bucket", F.lit("clash"))
    want = (cohorts["a"] | cohorts["b"]) - cohorts["c"]
    for skew in (None, SkewPolicy(rows_per_task=20)):
        got = rows_in(rows, bitmap, skew=skew)
        assert got.columns == rows.columns
        assert sorted(r.bits for r in got.collect()) == [k for k, r in enumerate(data) if r[0] in want]
        left = rows_in(rows, bitmap, negate=True, skew=skew).collect()
        assert sorted(r.bits for r in left) == [-1] + [k for k, r in enumerate(data) if r[0] not in want]


def test_edges(spark, index):
    none = cohort_index(spark.createDataFrame([], "patientId long, a boolean"), {"a": "a"})
    assert cohort_size(members(none, Cohort.named("a"))).first().n == 0
    assert cohort_ids(members(none, ~Cohort.named("a"))).isEmpty()
    with pytest.raises(TypeError):
        cohort_index(spark.createDataFrame([("x", True)], "patientId string, a boolean"), {"a": "a"})
    with pytest.raises(ValueError):
        cohort_index(spark.range(1).withColumnRenamed("id", "patientId"), {})
    with pytest.raises(ValueError):
        members(index, Cohort.named("nothing"))
