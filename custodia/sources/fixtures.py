"""Clinical tables derived from the driver's synthetic test tables.

The driver ships TPC-H-like tables and an ``events`` stream, not clinical
data. These builders derive the reference's data model from them with
plain column arithmetic (identical arithmetic is used by the DuckDB
oracle in ``__spark_entry__.py``):

* ``patientsProfiles``  <- customer x nation (one row per customer)
* ``blood_tests``       <- events (one measurement row per event)
* ``clauses``           <- customer (consent flags per patient)
* ``documents``         <- documents (each document assigned to a patient)

Every builder reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from custodia.functions.columns import COMPONENTS, NO_NORMAL_RANGE
from custodia.sources.catalog import Catalog

# Fixture parameters (not reference values): a component is measured on
# events whose id is a multiple of its modulus; its normal range text is
# "10-<10 x modulus>".
FIXTURE_MODULUS = {
    "antithrombin": 6,
    "cholesterol_hdl": 8,
    "cholesterol_ldl": 5,
    "cholesterol_total": 3,
    "cholesterol_tryglicerides": 9,
    "fibrinogen": 4,
    "haemoglobin": 7,
    "plateletCount": 10,
    "prothrombinTime": 11,
    "totalWhiteCellCount": 2,
}
FIXTURE_UNIT = "mg/dL"
STROKE_MODULUS = 97
DOCUMENT_PATIENTS = 150


# The driver's tables are read-only, so a schema inferred once per path is
# reused and later reads skip the inference job.
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    known = _SCHEMAS.get(path)
    if known is not None:
        return spark.read.schema(known).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = df.schema
    return df


def blood_tests_expressions() -> list[str]:
    """The measurement table as SQL expressions over ``events`` (valid in
    Spark and in DuckDB; the oracle inlines the same list)."""
    exprs = [
        "event_id AS testId",
        "user_id AS patientId",
        "CAST(ts AS DATE) AS date",
        "CASE WHEN event_type IN ('signup') THEN 'visit' ELSE 'blood_test' END AS category",
        f"CASE WHEN event_type = 'error' AND event_id % {STROKE_MODULUS} = 0 THEN 1 ELSE 0 END AS stroke",
        "CAST(18 + event_id % 20 AS INT) AS bmi",
    ]
    for comp in COMPONENTS:
        m = FIXTURE_MODULUS[comp]
        hit = f"event_id % {m} = 0"
        exprs.append(f"CASE WHEN {hit} THEN value END AS {comp}_value")
        exprs.append(f"CASE WHEN {hit} THEN '{FIXTURE_UNIT}' END AS {comp}_unit")
        if comp not in NO_NORMAL_RANGE:
            exprs.append(f"CASE WHEN {hit} THEN '10-{10 * m}' END AS {comp}_normalRange")
    return exprs


def blood_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one selectExpr: the 36 expressions are parsed JVM-side in one call
    return _table(spark, sf_dir, "events").selectExpr(*blood_tests_expressions())


# The profile, consent and document tables as SQL expressions over
# customer x nation, customer and documents (shared with the oracle).
PROFILE_EXPRESSIONS = [
    "c_custkey AS patientId",
    "c_name AS socialId",
    "c_name AS name",
    "c_mktsegment AS surname",
    "n_name AS nationality",
    "n_name AS birthCity",
    "n_name AS addressCity",
    "c_mktsegment AS addressRoad",
    "CAST(1 + c_custkey % 200 AS INT) AS addressRoadNumber",
    "CAST(10000 + c_custkey % 90000 AS VARCHAR(5)) AS addressPostalCode",
    "CAST(2000000000 + c_custkey AS VARCHAR(20)) AS addressTelephoneNumber",
    "CAST(6 + c_custkey % 14 AS INT) AS schoolYears",
    "c_mktsegment AS job",
    "CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender",
    "make_date(CAST(1930 + c_custkey % 80 AS INT), CAST(1 + c_custkey % 12 AS INT), "
    "CAST(1 + c_custkey % 28 AS INT)) AS birthDate",
]
CLAUSE_EXPRESSIONS = [
    "c_custkey AS patientId",
    "c_custkey % 5 <> 0 AS consent_labs",
    "c_custkey % 3 <> 0 AS consent_identity",
]
DOCUMENT_EXPRESSIONS = [
    "doc_id", f"doc_id % {DOCUMENT_PATIENTS} AS patientId", "lang", "source", "n_chars", "text",
]


def patients_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _table(spark, sf_dir, "customer")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .selectExpr(*PROFILE_EXPRESSIONS))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr(*CLAUSE_EXPRESSIONS)


def patient_documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr(*DOCUMENT_EXPRESSIONS)


def fixture_catalog(sf_dir: str) -> Catalog:
    """Catalog of the derived clinical tables under the reference's names."""
    return Catalog({
        "blood_tests": lambda s: blood_tests(s, sf_dir),
        "patientsProfiles": lambda s: patients_profiles(s, sf_dir),
        "blood_tests_clauses": lambda s: clauses(s, sf_dir),
        "documents": lambda s: patient_documents_table(s, sf_dir),
    })
