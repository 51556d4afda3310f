"""Movements are verified against the note of their stage and become visible
as a whole: altered stages, failing and empty re-runs, lost drivers."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from custodia.plans import MovementError, finish_movement, start_movement
from custodia.plans import movement
from custodia.plans.contents import Contents, table_contents

SCHEMA = "id long, g string, v double, a array<int>, m map<string,int>, s struct<x:int,y:string>, ts timestamp"


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "v").collect())


@pytest.fixture()
def rows(spark):
    return spark.range(100).selectExpr("id", "cast(id % 3 as string) AS g", "id / 4.0D AS v")


def parts(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_contents_do_not_depend_on_order_files_or_partitions(spark):
    rng = random.Random(3)
    data = [(k % 40, rng.choice("ab"), rng.choice([None, float("nan"), -0.0, 1.5]), [k % 40], {"k": 1}, (k % 40, None), None)
            for k in range(90)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = table_contents(df).first()
    assert whole == table_contents(df.repartition(7).orderBy(F.rand(3)).select(*reversed(df.columns))).first()
    halves = [table_contents(df.where(f"id % 2 = {k}")).first() for k in (0, 1)]
    total = sum((Contents.parse(*h) for h in halves), Contents())
    assert (total.rows, total.digest) == tuple(whole)
    assert table_contents(df.limit(0)).first() == (0, "0:0:0:0")
    # a repeated row, a moved bound between values and a NULL instead of a text all count
    for a, b in ((["x", "x"], ["x"]), (["-"], [None]), ([""], [None])):
        x, y = (spark.createDataFrame([(v,) for v in some], "t string") for some in (a, b))
        assert table_contents(x).first() != table_contents(y).first()
    x, y = (spark.createDataFrame([v], "a string, b string") for v in (("ab", "c"), ("a", "bc")))
    assert table_contents(x).first().digest != table_contents(y).first().digest


def test_contents_of_instants_do_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([(1,)], "x long").select(F.timestamp_micros(F.lit(1_600_000_000_000_000)).alias("t"))
    before, zone = table_contents(df).first(), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert table_contents(df).first() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("movement_id", [None, "m1"])
def test_altered_stages_leave_the_target_as_it_was(spark, rows, scratch, movement_id):
    stage, target = f"{scratch}/s", f"{scratch}/t"
    start_movement(rows.where("id < 10"), stage)
    finish_movement(spark, stage, target, movement_id=movement_id)
    before = rows_of(spark, target)

    def refused(match):
        with pytest.raises(MovementError, match=match):
            finish_movement(spark, stage, target, movement_id=movement_id)
        assert rows_of(spark, target) == before
        assert not [n for n in os.listdir(target) if n.startswith("_attempt")]

    start_movement(rows.repartition(4), stage)
    os.rename(parts(stage)[0], f"{scratch}/taken")                    # a missing part file
    refused("not what was staged")
    start_movement(rows.repartition(4), stage)
    rows.limit(1).write.mode("append").parquet(stage)                  # a foreign one
    refused("not what was staged")
    start_movement(rows.repartition(2), stage)
    rows.withColumn("v", F.col("v") + 1).coalesce(1).write.parquet(f"{scratch}/other")
    start_movement(rows.coalesce(1), stage)
    shutil.copyfile(parts(f"{scratch}/other")[0], parts(stage)[0])     # another one in its place
    for crc in [f for f in os.listdir(stage) if f.endswith(".crc")]:
        os.rename(f"{stage}/{crc}", f"{scratch}/{crc}")
    refused("not what was staged")
    start_movement(rows, stage)
    os.rename(f"{stage}/{movement.MANIFEST}", f"{scratch}/note")
    with pytest.raises(MovementError, match="incomplete"):
        finish_movement(spark, stage, target, movement_id=movement_id, require_note=True)
    os.rename(f"{stage}/_SUCCESS", f"{scratch}/success")               # a stage that was cut off
    refused("incomplete")


def test_empty_and_failing_reruns(spark, rows, scratch):
    stage, target = f"{scratch}/s", f"{scratch}/t"
    for m, kept in (("m1", "id < 10"), ("m2", "id >= 90")):
        start_movement(rows.where(kept), stage)
        finish_movement(spark, stage, target, movement_id=m, partition_by=["g"])
    start_movement(rows.where("id < 5"), stage)
    with pytest.raises(Exception):                                     # the job fails in the middle
        finish_movement(spark, stage, target, movement_id="m1", partition_by=["nothing"])
    assert {i for i, _ in rows_of(spark, target)} == {*range(10), *range(90, 100)}
    start_movement(rows.where("id < 0"), stage)
    report = finish_movement(spark, stage, target, movement_id="m1", partition_by=["g"])
    assert report.empty and {i for i, _ in rows_of(spark, target)} == set(range(90, 100))
    start_movement(rows.where("id = 1"), stage)
    finish_movement(spark, stage, target, movement_id="m1", partition_by=["g"])
    assert {i for i, _ in rows_of(spark, target)} == {1, *range(90, 100)}


@pytest.mark.parametrize("movement_id", [None, "m1"])
@pytest.mark.parametrize("lost_at", range(4))
def test_a_lost_driver_leaves_no_hole(spark, rows, scratch, monkeypatch, movement_id, lost_at):
    """The driver goes after the commit, before its ``lost_at``-th rename."""
    stage, target = f"{scratch}/s", f"{scratch}/t"
    start_movement(rows.where("id < 10").coalesce(2), stage)
    finish_movement(spark, stage, target, movement_id=movement_id)
    start_movement(rows.where("id >= 50").repartition(3), stage)
    real, seen = movement.Folders.rename, [0]

    def rename(self, old, new):
        if "_commits" not in new:
            if seen[0] == lost_at:
                raise KeyboardInterrupt("lost")
            seen[0] += 1
        real(self, old, new)

    monkeypatch.setattr(movement.Folders, "rename", rename)
    try:
        finish_movement(spark, stage, target, movement_id=movement_id)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    movement.recover(spark, target)
    want = set(range(50, 100)) | (set(range(10)) if movement_id is None else set())
    got = rows_of(spark, target)
    assert {i for i, _ in got} == want and len(got) == len(want)
    assert movement.recover(spark, target) == 0
    assert not [n for n in os.listdir(target) if n.startswith(("_attempt", "_old"))]


def test_notes_add_up_over_appended_runs(spark, rows, scratch):
    for k in (0, 1, 2):
        start_movement(rows.where(f"id % 3 = {k}"), f"{scratch}/s", mode="append", partition_by=["g"])
    report = finish_movement(spark, f"{scratch}/s", f"{scratch}/t")
    assert report.rows == 100 and (100, report.digest) == tuple(table_contents(rows).first())
    assert spark.read.parquet(f"{scratch}/t").schema["g"].dataType.simpleString() == "string"
    commits = [json.loads(open(f"{scratch}/t/_commits/{n}").read()) for n in os.listdir(f"{scratch}/t/_commits")
               if n.endswith(".done")]
    assert [c["rows"] for c in commits] == [100]
    start_movement(rows.withColumn("more", F.lit(1)), f"{scratch}/s", mode="append")
    with pytest.raises(MovementError, match="different columns"):
        finish_movement(spark, f"{scratch}/s", f"{scratch}/t")
