"""Stored partial sums against averages over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.plans import start_movement
from custodia.plans.partials import finish_with_partials, partial_sums, stored_averages, update_partials

SCHEMA = "patientId long, birthDate int, fibrinogen_value double, haemoglobin_value double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    return spark.createDataFrame(
        [(i, rng.choice([None, *range(1950, 1990)]), rng.choice([None, round(rng.random() * 100, 2)]), None if i % 3 else 1.5)
         for i in range(500)], SCHEMA)


def same(spark, store, rows, low=None, high=None):
    got = {r.component: (r.n, r.value) for r in stored_averages(spark, store, low, high, digits=6).collect()}
    band = rows
    if low is not None:
        band = band.where(f"birthDate > {low}")
    if high is not None:
        band = band.where(f"birthDate < {high}")
    want = {}
    for c in ("fibrinogen", "haemoglobin"):
        n, v = band.agg(F.count(f"{c}_value"), F.round(F.avg(f"{c}_value"), 6)).first()
        if n:
            want[c] = (n, v)
    assert set(got) == set(want)
    for c in want:
        assert got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1], abs=2e-6)


def test_movements_replacements_and_withdrawals(spark, rows, scratch):
    def move(movement_id, kept):
        start_movement(rows.where(kept), f"{scratch}/s")
        finish_with_partials(spark, f"{scratch}/s", f"{scratch}/t", f"{scratch}/store", movement_id, fill={})

    move("m1", "patientId < 200")
    same(spark, f"{scratch}/store", rows.where("patientId < 200"))
    move("m2", "patientId >= 300")
    same(spark, f"{scratch}/store", rows.where("patientId < 200 OR patientId >= 300"), 1960, 1980)
    move("m1", "patientId < 50")                                      # replaced
    left = rows.where("patientId < 50 OR patientId >= 300")
    for low, high in ((None, None), (1960, None), (None, 1960), (1960, 1961), (1989, 1990)):
        same(spark, f"{scratch}/store", left, low, high)
    move("m2", "patientId < 0")                                       # emptied
    same(spark, f"{scratch}/store", rows.where("patientId < 50"))
    only = stored_averages(spark, f"{scratch}/store", components=["haemoglobin"])
    assert [r.component for r in only.collect()] == ["haemoglobin"]
    assert f"{scratch}/t/" not in plan_text(only)


def test_a_store_left_behind_is_repaired(spark, rows, scratch, monkeypatch):
    from custodia.plans import partials
    start_movement(rows, f"{scratch}/s")

    def lost(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(partials, "update_partials", lost)
    with pytest.raises(KeyboardInterrupt):
        finish_with_partials(spark, f"{scratch}/s", f"{scratch}/t", f"{scratch}/store", "m1", fill={})
    monkeypatch.undo()
    finish_with_partials(spark, f"{scratch}/s", f"{scratch}/t", f"{scratch}/store", "m1", fill={})
    same(spark, f"{scratch}/store", rows)


def test_dates_fills_and_missing_components(spark, rows, scratch):
    dated = rows.withColumn("birthDate", F.make_date("birthDate", F.lit(2), F.lit(28)))
    assert sorted(map(repr, partial_sums(dated).collect())) == sorted(map(repr, partial_sums(rows).collect()))
    update_partials(spark, rows, f"{scratch}/store", "m1", f"{scratch}/s")
    same(spark, f"{scratch}/store", rows)
    with pytest.raises(ValueError):
        partial_sums(rows.select("patientId", "birthDate"))
    start_movement(rows.where("patientId < 10"), f"{scratch}/s2")
    finish_with_partials(spark, f"{scratch}/s2", f"{scratch}/t2", f"{scratch}/store2", "m1")     # gaps filled with 0.0
    same(spark, f"{scratch}/store2", rows.where("patientId < 10").na.fill({"fibrinogen_value": 0.0}))
