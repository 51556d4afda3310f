"""Sealed columns: round trips, masks, wrong and missing keys, altered cells."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.functions.sealing import (
    COLUMN_KEYS, CRYPTO_FACTORY, KEYSTORE, KeyUnavailable, Sealing, create_keystore, key_names,
    parse_column_keys, seal, sealed_columns, split_options, unseal,
)
from custodia.model import TableSpec
from custodia.plans import MovementError, finish_movement, start_movement
from custodia.sources.catalog import Catalog

SCHEMA = "id long, v double, t string, d date, b binary, i int, ts timestamp, x decimal(12,3), ok boolean"
ROWS = [(1, 0.1, "é|\n", dt.date(1960, 2, 29), bytearray(b"\x00\xff"), -5, dt.datetime(2020, 1, 2, 3, 4, 5, 6), Decimal("1.5"), True),
        (2, float("nan"), "", None, bytearray(b""), None, None, None, False), (3, -0.0, None, None, None, 7, None, Decimal("2"), None),
        (4, 1e300, "long " * 20000, dt.date(1, 1, 1), None, 0, None, Decimal("-3"), True)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('keys')}/store"
    create_keystore(spark, path, ["labs", "identity"])
    return path


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


SEALED = {"v": "labs", "t": "identity", "d": "identity", "b": "labs", "i": "labs", "ts": "labs", "x": "labs", "ok": "labs"}


def test_sealed_columns_come_back_as_they_were(spark, table, store, scratch):
    seal(table, Sealing(SEALED, store)).write.parquet(f"{scratch}/t")
    raw = spark.read.parquet(f"{scratch}/t")
    assert {c: t for c, t in raw.dtypes if c != "id"} == {c: "binary" for c in SEALED}
    assert sealed_columns(raw)["d"] == {"key": "identity", "type": "date"}
    clear = unseal(raw, store)
    assert clear.dtypes == table.dtypes and not sealed_columns(clear)
    assert sorted(map(repr, clear.collect())) == sorted(map(repr, table.collect()))


def test_without_their_key_cells_are_masked(spark, table, store, scratch):
    seal(table, Sealing(SEALED, store)).write.parquet(f"{scratch}/t")
    create_keystore(spark, f"{scratch}/some", ["others"])
    for keys in (None, f"{scratch}/none", f"{scratch}/some"):
        masked = unseal(spark.read.parquet(f"{scratch}/t"), keys)
        assert masked.dtypes == table.dtypes
        assert {r.id for r in masked.collect()} == {1, 2, 3, 4}
        assert masked.where(" OR ".join(f"{c} IS NOT NULL" for c in SEALED)).isEmpty()


def test_a_wrong_key_an_altered_cell_and_a_moved_cell_do_not_open(spark, table, store, scratch):
    sealed = seal(table.select("id", "v", "i"), Sealing({"v": "labs", "i": "labs"}, store))
    sealed.write.parquet(f"{scratch}/t")
    raw = spark.read.parquet(f"{scratch}/t")
    create_keystore(spark, f"{scratch}/other", ["labs"])
    with pytest.raises(Exception, match="(?i)aes|crypto|tag"):
        unseal(raw, f"{scratch}/other").collect()
    kept = {f.name: f.metadata for f in raw.schema.fields}
    cut = raw.withColumn("v", F.expr("overlay(v PLACING X'00' FROM 20)").alias("v", metadata=kept["v"]))
    with pytest.raises(Exception, match="(?i)aes|crypto|tag"):
        unseal(cut, store).collect()
    swapped = raw.select("id", F.col("i").alias("v", metadata=kept["v"]))
    with pytest.raises(Exception, match="(?i)aes|crypto|tag"):
        unseal(swapped, store).collect()


def test_equal_values_have_different_cells(spark, store):
    rows = spark.range(1000).select("id", F.lit(7.5).alias("v"))
    cells = seal(rows, Sealing({"v": "labs"}, store)).select(F.hex("v").alias("v"), F.substring("v", 1, 2).alias("k")).collect()
    assert len({r.v for r in cells}) == 1000 and len({bytes(r.k) for r in cells}) > 500


def test_key_bytes_stand_in_no_plan(spark, table, store):
    sealed = seal(table, Sealing(SEALED, store))
    text = plan_text(sealed, "extended")
    for key in spark.read.json(store).collect():
        assert key.key not in text
    assert key_names(spark, store) == {"labs", "identity"}


def test_properties(spark, table, store, scratch):
    assert parse_column_keys("a: x, y ; b:z;") == {"x": "a", "y": "a", "z": "b"}
    for bad in ("a", "a:", ":x", "a:x;b:x"):
        with pytest.raises(ValueError):
            parse_column_keys(bad)
    assert split_options(None) == (Sealing(), {})
    native = {CRYPTO_FACTORY: "a.Factory", COLUMN_KEYS: "a:x"}
    assert split_options(native) == (Sealing(), native)              # the source encrypts by itself
    with pytest.raises(KeyUnavailable):                              # never written in the clear
        split_options({COLUMN_KEYS: "labs:v"})
    with pytest.raises(KeyUnavailable):
        seal(table, Sealing({"v": "lost"}, store))
    with pytest.raises(ValueError):
        seal(table, Sealing({"nothing": "labs"}, store))
    with pytest.raises(TypeError):
        seal(spark.createDataFrame([(1, [1])], "id int, a array<int>"), Sealing({"a": "labs"}, store))
    with pytest.raises(Exception, match="(?i)already exists"):
        create_keystore(spark, store, ["labs"])
    clash = table.select("id", F.lit(1).alias("__subkey"), "v")
    assert unseal(seal(clash, Sealing({"v": "labs"}, store)), store).columns == clash.columns


def test_moving_sealed_columns(spark, store, scratch):
    rows = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "patientId long, fibrinogen_value double, gender string")
    options = {COLUMN_KEYS: "labs: fibrinogen_value", KEYSTORE: store}
    start_movement(rows, f"{scratch}/s", options=options)
    finish_movement(spark, f"{scratch}/s", f"{scratch}/t", options=options)       # filled, sealed again
    finish_movement(spark, f"{scratch}/s", f"{scratch}/blind")                    # sealed as staged
    opened = {n: Catalog({"t": TableSpec("t", "parquet", f"{scratch}/{n}")}).load(spark, "t", **{KEYSTORE: store})
              for n in ("t", "blind")}
    assert sorted(map(tuple, opened["t"].collect())) == [(1, 2.5, "a"), (2, 0.0, "b")]
    assert sorted(map(tuple, opened["blind"].collect())) == [(1, 2.5, "a"), (2, None, "b")]
    start_movement(rows, f"{scratch}/clear")
    with pytest.raises(MovementError):                                            # clear rows into a sealed table
        finish_movement(spark, f"{scratch}/clear", f"{scratch}/t")
    with pytest.raises(ValueError):
        start_movement(rows, f"{scratch}/p", options=options, partition_by=["fibrinogen_value"])


def test_sealed_catalog_tables(spark, store, scratch):
    spec = TableSpec("t", "parquet", f"{scratch}/t", {COLUMN_KEYS: "labs: v", KEYSTORE: store})
    catalog = Catalog({"t": spec})
    for part in (0, 1):
        catalog.save(spark.range(3).selectExpr("id", f"id + {part} / 2.0 AS v").selectExpr("id", "CAST(v AS DOUBLE) AS v"), "t")
    assert spark.read.parquet(f"{scratch}/t").schema["v"].dataType.simpleString() == "binary"
    assert sorted(r.v for r in catalog.load(spark, "t").collect()) == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]
    blind = Catalog({"t": TableSpec("t", "parquet", f"{scratch}/t")})
    assert {r.v for r in blind.load(spark, "t").collect()} == {None}
