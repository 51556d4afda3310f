"""Keyed pseudonyms against plain versions."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from custodia.functions.keyed import ROUNDS, keystore_key, mac, permute, pseudonymise, restore, restore_ids
from custodia.functions.sealing import create_keystore

IDS = [0, 1, -1, 7, 2**31, 2**32, -2**32, 2**63 - 1, -2**63, 123456789012345]


def plain(value, key):
    left, right = (value >> 32) & 0xFFFFFFFF, value & 0xFFFFFFFF
    for n in range(1, ROUNDS + 1):
        digest = int(hashlib.sha256(f"{key}|{n}|{right}".encode()).hexdigest()[:8], 16)
        left, right = right, left ^ digest
    out = left << 32 | right
    return out - 2**64 if out >= 2**63 else out


def test_permute_equals_the_plain_network_and_comes_back(spark):
    df = spark.createDataFrame([(i,) for i in IDS] + [(None,)], "id long")
    got = df.select("id", permute("id", "k1").alias("p"), restore(permute("id", "k1"), "k1").alias("back"),
                    restore(permute("id", "k1"), "k2").alias("wrong")).collect()
    assert {r.id: r.p for r in got} == {i: plain(i, "k1") for i in IDS} | {None: None}
    assert all(r.back == r.id for r in got) and all(r.wrong != r.id for r in got if r.id is not None)


def test_permute_is_one_to_one(spark):
    made = spark.range(50_000).select(permute("id", "k").alias("p"))
    assert made.distinct().count() == 50_000
    assert abs(made.where("p < 0").count() - 25_000) < 1000


@pytest.mark.parametrize("key", ["k", "a key é", "x" * 64, "y" * 200])
def test_mac_equals_hmac(spark, key):
    texts = ["Customer#000000007", "", "é", "long " * 1000]
    got = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", mac("t", key).alias("m")).collect()
    assert {r.t: r.m for r in got} == {
        t: hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts} | {None: None}


def test_keys_of_a_keystore(spark, scratch):
    create_keystore(spark, f"{scratch}/keys", ["ids"])
    key = spark.read.json(f"{scratch}/keys").first().key
    df = spark.createDataFrame([(5, "a")], "id long, t string")
    made = pseudonymise(df, "id", keystore_key(spark, f"{scratch}/keys", "ids"))
    assert made.first().id == plain(5, key) and key not in plan_text(made, "extended")
    assert "EvalPython" not in plan_text(made)
    assert restore_ids(made, "id", keystore_key(spark, f"{scratch}/keys", "ids")).first().id == 5
    lost = keystore_key(spark, f"{scratch}/keys", "lost")
    assert pseudonymise(df, "id", lost).first().id is None
    assert pseudonymise(df, "t", lost, "mac").first().t is None


def test_arguments(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        pseudonymise(df, "id", "")
    with pytest.raises(ValueError):
        pseudonymise(df, "id", "k", "md5")
    assert pseudonymise(df.withColumn("l", F.lit("clash")), "id", "k").columns == ["id", "l"]
