from pyspark.sql import functions as F

from custodia.functions import pseudonym_of
from custodia.operators import (
    drop_denied_rows, generalise_birth_date, mask_by_clauses, pseudonymise_id, suppress_id,
)


def test_sha2_pseudonym_keeps_null_and_matches_lookup(spark):
    df = spark.createDataFrame([("A1",), (None,)], "socialId string")
    out = pseudonymise_id(df).collect()
    assert out[1].socialId is None
    assert len(out[0].socialId) == 64
    assert pseudonymise_id(df).where(F.col("socialId") == pseudonym_of("A1")).count() == 1


def test_salt_changes_the_pseudonym(spark):
    df = spark.createDataFrame([("A1",)], "socialId string")
    a = pseudonymise_id(df).first().socialId
    b = pseudonymise_id(df, salt="s3cret").first().socialId
    assert a != b


def test_murmur3_parity(spark):
    df = spark.createDataFrame([("A1",), (None,)], "socialId string")
    out = [r.socialId for r in pseudonymise_id(df, method="murmur3").collect()]
    assert out[1] == 42 and isinstance(out[0], int)


def test_generalise_and_suppress(spark):
    df = spark.sql("SELECT 5L AS patientId, DATE'1971-06-30' AS birthDate")
    row = suppress_id(generalise_birth_date(df)).first()
    assert row.birthDate == 1971 and row.patientId == 0


def test_masking_keeps_only_consented_cells_and_never_fills_nulls(spark):
    data = spark.createDataFrame(
        [(1, 1.0, "a"), (2, 2.0, "b"), (3, None, "c"), (4, 4.0, "d")],
        "patientId long, lab double, note string")
    clauses = spark.createDataFrame([(1, True), (2, False), (3, True)],
                                    "patientId long, consent_labs boolean")
    masked = mask_by_clauses(data, clauses, {"lab": "consent_labs", "note": "consent_labs"})
    got = {r.patientId: (r.lab, r.note) for r in masked.collect()}
    assert got == {1: (1.0, "a"), 2: (None, None), 3: (None, "c"), 4: (None, None)}
    assert sorted(r.patientId for r in drop_denied_rows(masked).collect()) == [1, 3]


def test_masking_with_expression_rule(spark):
    data = spark.createDataFrame([(1, 1.0), (2, 2.0)], "patientId long, lab double")
    clauses = spark.createDataFrame([(1, True, False), (2, True, True)],
                                    "patientId long, c1 boolean, c2 boolean")
    masked = mask_by_clauses(data, clauses, {"lab": F.col("c1") & F.col("c2")})
    assert {r.patientId: r.lab for r in masked.collect()} == {1: None, 2: 2.0}


def test_masking_with_drop_denied_equals_mask_then_drop(spark):
    data = spark.createDataFrame(
        [(1, 1.0, None), (2, None, None), (3, None, "c"), (4, 4.0, "d"), (None, 5.0, None)],
        "patientId long, lab double, note string")
    clauses = spark.createDataFrame([(1, True), (3, True), (4, False)],
                                    "patientId long, consent_labs boolean")
    rules = {"lab": "consent_labs", "note": "consent_labs"}
    one_step = mask_by_clauses(data, clauses, rules, drop_denied=True)
    two_steps = drop_denied_rows(mask_by_clauses(data, clauses, rules))
    assert sorted(map(repr, one_step.collect())) == sorted(map(repr, two_steps.collect()))
    assert sorted(r.patientId for r in one_step.collect()) == [1, 3]
