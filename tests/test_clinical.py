import datetime as dt

import pytest
from pyspark.sql import functions as F

from custodia.functions import birth_year_filter, component_column
from custodia.model import Zone
from custodia.operators import (
    age_band_average, birth_years, component_series, generalise_birth_date, nutritional_data,
    patient_details, patient_documents,
)

from conftest import plan_text

BIRTHS = ["1990-01-01", "1990-05-01", "2004-12-31", "2005-01-01", "2005-06-01"]


def test_component_column_allow_list():
    assert component_column("cholesterol") == "cholesterol_total_value"
    assert component_column("fibrinogen") == "fibrinogen_value"
    with pytest.raises(ValueError):
        component_column("fibrinogen_value; DROP TABLE x")


def test_birth_years_and_bad_range():
    assert birth_years(36, 66, dt.date(2026, 3, 1)) == (1960, 1990)
    with pytest.raises(ValueError):
        birth_years(40, 40)


@pytest.mark.parametrize("kind,expected", [
    ("date", ["1990-01-01", "1990-05-01", "2004-12-31"]),
    ("string", ["1990-01-01", "1990-05-01", "2004-12-31"]),
    ("year", ["2004-12-31"]),
])
def test_birth_band_semantics_by_storage(spark, kind, expected):
    df = spark.createDataFrame([(b,) for b in BIRTHS], "b string")
    if kind == "date":
        df = df.select(F.to_date("b").alias("birthDate"), "b")
    elif kind == "year":
        df = df.select(F.year(F.to_date("b")).alias("birthDate"), "b")
    else:
        df = df.select(F.col("b").alias("birthDate"), "b")
    got = sorted(r.b for r in df.where(birth_year_filter(df, "birthDate", 1990, 2005)).collect())
    assert got == expected


def test_malformed_text_birth_dates_match_no_band(spark):
    df = spark.createDataFrame([("1970-05-01",), ("n/a",), (None,)], "birthDate string")
    got = [r.birthDate for r in df.where(birth_year_filter(df, "birthDate", 1960, 1990)).collect()]
    assert got == ["1970-05-01"]


def test_date_band_is_pushed_to_parquet(spark, scratch):
    path = f"{scratch}/p"
    spark.createDataFrame([(dt.date(1970, 1, 1),)], "birthDate date").write.parquet(path)
    df = spark.read.parquet(path)
    from conftest import plan_text
    text = plan_text(df.where(birth_year_filter(df, "birthDate", 1960, 1990)))
    assert "PushedFilters: [IsNotNull(birthDate), GreaterThanOrEqual(birthDate" in text


def _tests(spark):
    return spark.createDataFrame(
        [(1, 10, dt.date(2020, 1, 1), "blood_test", 0, 20, 5.0, 1.0, None),
         (2, 10, dt.date(2020, 2, 1), "blood_test", 1, 21, None, 2.0, 7.0),
         (3, 11, dt.date(2020, 3, 1), "visit", 0, 22, 6.0, None, None),
         (4, 12, None, "blood_test", 0, 23, None, None, 9.0)],
        "testId long, patientId long, date date, category string, stroke int, bmi int, "
        "cholesterol_total_value double, cholesterol_ldl_value double, fibrinogen_value double")


def _profiles(spark):
    return spark.createDataFrame(
        [(10, "S10", "female", dt.date(1970, 1, 1)), (11, "S11", "male", dt.date(1990, 1, 1)),
         (12, "S12", "male", dt.date(1960, 1, 1))],
        "patientId long, socialId string, gender string, birthDate date")


HAVE = ("patientId", "socialId", "gender", "birthDate")


def test_a_missing_column_is_an_error(spark):
    t, p = _tests(spark), _profiles(spark)
    with pytest.raises(ValueError, match="addressCity"):
        patient_details(p, "S10")
    with pytest.raises(ValueError, match="bmi"):
        nutritional_data(t.drop("bmi"), p)
    columns = ("patientId", "gender")
    assert nutritional_data(t.drop("bmi"), p, columns=columns).columns == list(columns)


def test_a_text_that_is_no_date_has_no_birth_year(spark):
    p = _profiles(spark).selectExpr(
        "patientId", "gender", "CASE patientId WHEN 10 THEN 'unknown' ELSE CAST(birthDate AS STRING) END birthDate")
    years = {r.patientId: r.birthDate for r in generalise_birth_date(p).collect()}
    assert years == {10: None, 11: 1990, 12: 1960}


def test_text_birth_band_reaches_the_scan(spark, scratch):
    p = _profiles(spark).selectExpr("patientId", "CAST(birthDate AS STRING) AS birthDate")
    p.unionByName(spark.createDataFrame([(13, "1970-99-99"), (14, None)], p.schema)).write.parquet(f"{scratch}/p")
    stored = spark.read.parquet(f"{scratch}/p")
    band = stored.where(birth_year_filter(stored, "birthDate", 1960, 1990))
    assert sorted(r.patientId for r in band.collect()) == [10, 12]
    text = plan_text(band)
    assert "GreaterThanOrEqual(birthDate,1960)" in text and "LessThan(birthDate,1990)" in text


def test_component_series_reference_semantics(spark):
    t = _tests(spark)
    assert component_series(t, "cholesterol").count() == 3  # row 4: no date, no value
    assert component_series(t, "cholesterol", measured_only=True).count() == 2
    assert component_series(t, "cholesterol", patient_id=10).count() == 2


def test_age_band_average_private_and_empty(spark):
    t, p = _tests(spark), _profiles(spark)
    # ages 36..66 as of 2026 -> births 1960..1989: patients 10 and 12
    avg = age_band_average(t, p, "fibrinogen", 36, 66, as_of=dt.date(2026, 1, 1)).first().value
    assert avg == pytest.approx(8.0)
    none = age_band_average(t, p, "fibrinogen", 1, 2, as_of=dt.date(2026, 1, 1)).first().value
    assert none is None


def test_nutritional_cohort_and_top_k(spark):
    t, p = _tests(spark), _profiles(spark)
    rows = nutritional_data(t, p).collect()
    assert sorted(r.patientId for r in rows) == [10, 10]
    top = nutritional_data(t, p, limit=1, order_by="testId").collect()
    assert len(top) == 1 and top[0].cholesterol_total_value == 5.0


def test_patient_details_private_lookup(spark):
    from custodia.operators import pseudonymise_id
    p = pseudonymise_id(_profiles(spark))
    assert patient_details(p, "S11", zone=Zone.PRIVATE, columns=HAVE).first().patientId == 11
    assert patient_details(p, "S11", columns=HAVE).count() == 0  # clear text never matches a pseudonym


def test_documents_no_match_and_missing_id(spark):
    docs = spark.createDataFrame([(1, 7, "t")], "doc_id long, patientId long, text string")
    assert patient_documents(docs, 8).count() == 0
    assert patient_documents(docs, "7").count() == 1  # text id, as the reference sends it
    with pytest.raises(ValueError):
        patient_documents(docs, "")


def test_private_zone_returns_birth_years(spark):
    t, p = _tests(spark), _profiles(spark)
    rows = nutritional_data(t, p, zone=Zone.PRIVATE).collect()
    assert {r.birthDate for r in rows} == {1970}
    from custodia.operators import pseudonymise_id
    details = patient_details(pseudonymise_id(p), "S11", zone=Zone.PRIVATE, columns=HAVE).first()
    assert details.birthDate == 1990
