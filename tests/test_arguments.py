"""Bad arguments fail fast, before any job runs."""

import pytest
from pyspark.sql import functions as F

from custodia.functions import pseudonym
from custodia.model import Zone
from custodia.operators import (
    SkewPolicy, mask_by_clauses, not_in_cohort, nutritional_data, public_export, salted_join,
)


@pytest.fixture(scope="module")
def frames(spark):
    t = spark.createDataFrame([(1, 10, 0, "blood_test")],
                              "testId long, patientId long, stroke int, category string")
    p = spark.createDataFrame([(10, "f")], "patientId long, gender string")
    return t, p


def test_skew_policy_values():
    with pytest.raises(ValueError):
        SkewPolicy(rows_per_task=0)
    with pytest.raises(ValueError):
        SkewPolicy(buckets=0)


def test_salted_join_keeps_the_fact_side_only(frames):
    t, p = frames
    with pytest.raises(ValueError):
        salted_join(t, p, "patientId", "right")


def test_export_and_cohort_modes(frames):
    t, p = frames
    with pytest.raises(ValueError):
        public_export(t, p, plan="three_branch")
    with pytest.raises(ValueError):
        public_export(t, p, null_ids="maybe")
    with pytest.raises(ValueError):
        not_in_cohort(t, t, null_ids="maybe")


def test_missing_profiles_outside_public_zone(frames):
    t, _ = frames
    with pytest.raises(ValueError):
        nutritional_data(t, None, zone=Zone.ON_PREM)


def test_masking_rules_must_name_data_columns(frames):
    t, p = frames
    with pytest.raises(ValueError):
        mask_by_clauses(t, p, {"nope": "gender"})


def test_unknown_pseudonym_method():
    with pytest.raises(ValueError):
        pseudonym(F.col("socialId"), method="md5")


def test_zone_from_int_and_access():
    assert Zone.parse(1) is Zone.PRIVATE
    assert Zone.PRIVATE.access == "read" and Zone.PUBLIC.access == "read_public_cloud"
