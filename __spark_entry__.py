"""

``entry(spark)`` runs the flagship query (the anonymised public export) on
callable ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives the same
query as DuckDB SQL over the driver's tables. The clinical tables are
derived from the driver's tables (``custodia.sources.fixtures``); the
oracle inlines the same derivations as CTEs.
"""

from __future__ import annotations

import datetime as _dt
import functools
import itertools
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The package lives next to this file; make it importable however this
# module is loaded (by name from the repo root or by file path).
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from custodia.functions.columns import COMPONENTS, MEASUREMENT_COLUMNS, PROFILE_COLUMNS
from custodia.model import GovernedPlan, PolicyRequest, TableSpec, Zone
from custodia.operators import (
    PUBLIC_COLUMNS,
    DEFAULT_SKEW, SkewPolicy, age_band_average, age_band_values, cohort_and_hot_keys,
    drop_denied_rows, generalise_birth_date, in_cohort, json_component, component_average, component_series, mask_by_clauses, not_in_cohort,
    nutritional_data, patient_details, patient_documents, pseudonymise_id, public_export,
    parse_variant_rows, quasi_identifier_groups, stroke_cohort, tests_with_profiles, to_json_rows,
    to_variant_rows, variant_component,
)
from custodia.functions.keyed import keystore_key, pseudonymise, restore_ids
from custodia.functions.sealing import COLUMN_KEYS, KEYSTORE, create_keystore
from custodia.operators.anonymity import anonymous, calendar, keep_or_hide, year_bands
from custodia.operators.bitmaps import Cohort, cohort_ids, cohort_index, cohort_size, members, rows_in
from custodia.plans.contents import table_contents
from custodia.plans.governed import governed_lineage, governed_query, run_governed
from custodia.plans.movement import (
    MovementError, fill_present, finish_governed, finish_movement, stage_governed, stage_governed_export,
    start_movement,
)
from custodia.plans.partials import finish_with_partials, stored_averages
from custodia.session import checkpoint_path
from custodia.sources.bucketed import write_bucketed
from custodia.sources.catalog import Catalog
from custodia.sources.fixtures import (
    CLAUSE_EXPRESSIONS, DOCUMENT_EXPRESSIONS, PROFILE_EXPRESSIONS, blood_tests_expressions,
    fixture_catalog,
)

SMOKE_DIR = "/root/testdata/sf0.001"

# Query parameters (fixed so results are reproducible).
AS_OF = _dt.date(2026, 1, 1)
AGE_BAND = (36, 66)          # births 1960 .. 1989
PATIENT = 7
SOCIAL_ID = "Customer#000000007"
TOP_K = 20


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _tables(spark: SparkSession, sf_dir: str):
    cat = fixture_catalog(sf_dir)
    return cat, cat.load(spark, "blood_tests"), cat.load(spark, "patientsProfiles")


def _export(spark, sf_dir, **kw) -> DataFrame:
    _, bt, pp = _tables(spark, sf_dir)
    return public_export(bt, pp, **kw)


def q_component_series(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return component_series(bt, "cholesterol")


def q_component_series_measured(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return component_series(bt, "cholesterol", measured_only=True)


def q_avg_age(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return age_band_average(bt, pp, "fibrinogen", *AGE_BAND, as_of=AS_OF, digits=6)


def q_age_band_values(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return age_band_values(bt, pp, "fibrinogen", *AGE_BAND, as_of=AS_OF)


def q_json_average(spark, sf_dir):
    # The reference's two-hop path: governed rows as JSON texts, one field
    # read back with json_tuple, then averaged.
    _, bt, pp = _tables(spark, sf_dir)
    rows = to_json_rows(age_band_values(bt, pp, "fibrinogen", *AGE_BAND, as_of=AS_OF))
    return component_average(json_component(rows, "fibrinogen_value"), "fibrinogen_value", digits=6)


def q_variant_average(spark, sf_dir):
    # the two-hop path with typed rows: stored as VARIANT, one field read back
    folder, (_, bt, pp) = _folder(spark), _tables(spark, sf_dir)
    to_variant_rows(age_band_values(bt, pp, "fibrinogen", *AGE_BAND, as_of=AS_OF)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    return component_average(variant_component(rows, "fibrinogen_value"), "fibrinogen_value", digits=6)


# Row texts of which some are cut off, hold a word for a number or no field.
ROUGH_TEXT = ("CASE WHEN testId % 7 = 0 THEN '{\"fibrinogen_value\": ' WHEN testId % 11 = 0 THEN "
              "'{\"fibrinogen_value\": \"high\"}' WHEN testId % 13 = 0 THEN '{}' WHEN testId % 17 = 0 THEN NULL "
              "ELSE '{\"fibrinogen_value\": ' || CAST(fibrinogen_value AS VARCHAR(40)) || '}' END")


def q_variant_texts(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    texts = bt.where("fibrinogen_value IS NOT NULL").select("testId", F.expr(ROUGH_TEXT).alias("value"))
    parsed = parse_variant_rows(texts)
    known = F.col("value").isNotNull()
    return parsed.select("testId", known.alias("parsed"), F.try_variant_get(
        "value", "$.fibrinogen_value", "double").alias("fibrinogen_value"))


def q_partial_averages(spark, sf_dir):
    # two movements and a smaller re-run of the first, averaged from the stored sums
    folder, export = _folder(spark), _public_table(spark, sf_dir)
    for movement_id, rows in (("m1", "stroke = 0"), ("m2", "stroke = 1"), ("m1", "stroke = 0 AND bmi > 25")):
        start_movement(export.where(rows), f"{folder}/staging")
        finish_with_partials(spark, f"{folder}/staging", f"{folder}/target", f"{folder}/store", movement_id, fill={})
    return stored_averages(spark, f"{folder}/store", 1960, 1990, digits=6)


def q_json_rows(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return to_json_rows(component_series(bt, "cholesterol"))


def q_patient_details(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    return patient_details(pp, SOCIAL_ID)


def q_patient_details_private(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    private_store = pseudonymise_id(pp, "socialId", method="sha2")
    return patient_details(private_store, SOCIAL_ID, zone=Zone.PRIVATE, method="sha2")


def q_documents(spark, sf_dir):
    cat = fixture_catalog(sf_dir)
    return patient_documents(cat.load(spark, "documents"), PATIENT)


def q_nutritional(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return nutritional_data(bt, pp)


def q_nutritional_private(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return nutritional_data(bt, pp, zone=Zone.PRIVATE)


def q_nutritional_top20(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return nutritional_data(bt, pp, limit=TOP_K, order_by="testId")


def q_stroke_cohort(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return stroke_cohort(bt)


def q_in_cohort(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    cohort, hot = cohort_and_hot_keys(bt, None, "patientId", DEFAULT_SKEW)
    return in_cohort(bt.select("testId", "patientId"), cohort, hot=hot)


def q_not_in_cohort(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    cohort, hot = cohort_and_hot_keys(bt, None, "patientId", DEFAULT_SKEW)
    return not_in_cohort(bt.select("testId", "patientId"), cohort, null_ids="strict", hot=hot)


def q_tests_with_profiles(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return tests_with_profiles(bt, pp)


def q_public_export(spark, sf_dir):
    return _export(spark, sf_dir)


def q_public_export_all(spark, sf_dir):
    return _export(spark, sf_dir, distinct=False)


def q_public_export_strict(spark, sf_dir):
    return _export(spark, sf_dir, null_ids="strict")


def q_public_export_where(spark, sf_dir):
    return _export(spark, sf_dir, where="blood_tests.fibrinogen_value IS NOT NULL")


def q_public_export_top20(spark, sf_dir):
    return _export(spark, sf_dir, limit=TOP_K, order_by=list(PUBLIC_COLUMNS))


def _folder(spark) -> str:
    """A new folder on the shared storage that spark.checkpoint.dir names."""
    return checkpoint_path(spark, f"movement-{uuid.uuid4().hex}")


_PUBLIC_TABLES: dict[tuple[str, str], str] = {}


def _public_table(spark, sf_dir) -> DataFrame:
    """The public zone's table: the export, moved there once per application
    by stroke flag, as its readers find it."""
    stored = (spark.sparkContext.applicationId, sf_dir)
    if stored not in _PUBLIC_TABLES:
        folder = _folder(spark)
        start_movement(_export(spark, sf_dir), f"{folder}/staging")
        finish_movement(spark, f"{folder}/staging", f"{folder}/public", fill={},
                        partition_by=["stroke"], sort_within=["birthDate"])
        _PUBLIC_TABLES[stored] = f"{folder}/public"
    return spark.read.parquet(_PUBLIC_TABLES[stored])


def q_public_cohort(spark, sf_dir):
    return nutritional_data(_public_table(spark, sf_dir), zone=Zone.PUBLIC)


def q_public_avg_age(spark, sf_dir):
    return age_band_average(_public_table(spark, sf_dir), None, "fibrinogen", *AGE_BAND,
                            as_of=AS_OF, zone=Zone.PUBLIC, digits=6)


def q_birth_year_int(spark, sf_dir):
    return age_band_values(_public_table(spark, sf_dir), None, "fibrinogen", *AGE_BAND,
                           as_of=AS_OF, zone=Zone.PUBLIC)


def q_public_group_sizes(spark, sf_dir):
    return quasi_identifier_groups(_public_table(spark, sf_dir))


def q_public_tests(spark, sf_dir):
    return tests_with_profiles(_public_table(spark, sf_dir), None, zone=Zone.PUBLIC)


def q_movement_round_trip(spark, sf_dir):
    folder = _folder(spark)
    start_movement(_export(spark, sf_dir), f"{folder}/staging")
    finish_movement(spark, f"{folder}/staging", f"{folder}/target")
    return spark.read.parquet(f"{folder}/target")


def q_movement_rerun(spark, sf_dir):
    # the second run of the movement brings fewer rows: no other may stay
    folder, export = _folder(spark), _public_table(spark, sf_dir)
    for rows in (export, export.where("stroke = 1")):
        start_movement(rows, f"{folder}/staging")
        finish_movement(spark, f"{folder}/staging", f"{folder}/target", movement_id="m1",
                        partition_by=["stroke"])
    return spark.read.parquet(f"{folder}/target").drop("movement_id")


def q_movement_refused(spark, sf_dir):
    # a staging path that exists is refused and keeps its rows
    folder, (_, bt, _) = _folder(spark), _tables(spark, sf_dir)
    rows = bt.select("testId", "fibrinogen_value")
    start_movement(rows.where("fibrinogen_value IS NOT NULL"), folder, mode="errorifexists")
    try:
        start_movement(rows, folder, mode="errorifexists")
    except AnalysisException:
        return spark.read.parquet(folder)
    raise AssertionError("an existing staging path was replaced")


def q_movement_report(spark, sf_dir):
    folder, export = _folder(spark), _public_table(spark, sf_dir)
    made = [(name, start_movement(export.where(rows), f"{folder}/{name}"))
            for name, rows in (("all", "true"), ("nobody", "stroke > 1"))]
    return spark.createDataFrame([(n, r.rows, r.empty) for n, r in made],
                                 "step string, moved long, empty boolean")


def q_movement_emptied(spark, sf_dir):
    # everybody of the first movement withdraws: its re-run has no rows left
    folder, (_, bt, _) = _folder(spark), _tables(spark, sf_dir)
    rows = bt.select("testId", "patientId", "stroke", "fibrinogen_value")
    runs = [("m1", "stroke = 1"), ("m2", "testId % 5 = 0"), ("m1", "stroke > 1")]
    for movement_id, kept in runs:
        start_movement(rows.where(kept), f"{folder}/staging")
        finish_movement(spark, f"{folder}/staging", f"{folder}/target", movement_id=movement_id, fill={},
                        partition_by=["stroke"])
    return spark.read.parquet(f"{folder}/target")


def q_movement_altered_stage(spark, sf_dir):
    # a part file that was not staged by the movement: the re-run is refused
    # while it moves, and the earlier run's rows stay
    folder, (_, bt, _) = _folder(spark), _tables(spark, sf_dir)
    rows = bt.select("testId", "patientId", "stroke", "fibrinogen_value")
    start_movement(rows.where("testId % 2 = 0"), f"{folder}/staging")
    finish_movement(spark, f"{folder}/staging", f"{folder}/target", movement_id="m1", fill={})
    start_movement(rows, f"{folder}/staging")
    rows.where("stroke = 1").write.mode("append").parquet(f"{folder}/staging")
    try:
        finish_movement(spark, f"{folder}/staging", f"{folder}/target", movement_id="m1", fill={})
    except MovementError:
        return spark.read.parquet(f"{folder}/target").drop("movement_id")
    raise AssertionError("an altered stage was moved")


def q_movement_digest(spark, sf_dir):
    # rows and digest as noted by the stage, as moved, and as the target holds them
    folder, (_, bt, _) = _folder(spark), _tables(spark, sf_dir)
    rows = bt.select("testId", "patientId", "date", "stroke")
    staged = start_movement(rows, f"{folder}/staging", partition_by=["stroke"])
    moved = finish_movement(spark, f"{folder}/staging", f"{folder}/target", fill={}, sort_within=["patientId"])
    noted = spark.createDataFrame([(n, r.rows, r.digest) for n, r in (("staged", staged), ("moved", moved))],
                                  "step string, rows long, digest string")
    held = table_contents(spark.read.parquet(f"{folder}/target").select(*rows.columns))
    return noted.unionByName(held.withColumn("step", F.lit("target")))


def _sealed_movement(spark, sf_dir) -> tuple[Catalog, str]:
    """The consent-masked measurements, moved with two columns sealed under
    one key and one under another."""
    folder = _folder(spark)
    create_keystore(spark, f"{folder}/keys", ["labs", "identity"])
    options = {COLUMN_KEYS: "labs: cholesterol_total_value, fibrinogen_value; identity: date",
               KEYSTORE: f"{folder}/keys"}
    plan = GovernedPlan(sql=GOVERNED_SQL, tables=("blood_tests", "blood_tests_clauses"), write_options=options)
    stage_governed(spark, plan, fixture_catalog(sf_dir), f"{folder}/staging")
    finish_movement(spark, f"{folder}/staging", f"{folder}/target", options=options)
    return Catalog({"moved": TableSpec("moved", "parquet", f"{folder}/target")}), f"{folder}/keys"


def q_sealed_movement(spark, sf_dir):
    moved, keys = _sealed_movement(spark, sf_dir)
    return moved.load(spark, "moved", **{KEYSTORE: keys})


def q_sealed_masked(spark, sf_dir):
    moved, _ = _sealed_movement(spark, sf_dir)
    return moved.load(spark, "moved")


def q_governed_lineage(spark, sf_dir):
    plan = GovernedPlan(sql=GOVERNED_SQL, tables=("blood_tests", "blood_tests_clauses"))
    return governed_lineage(spark, plan, fixture_catalog(sf_dir))


def q_catalog_append(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    target = Catalog({"flags": TableSpec("flags", "parquet", _folder(spark))})
    for flag in (0, 1):
        target.save(bt.select("testId", "patientId", "stroke").where(F.col("stroke") == flag), "flags")
    return target.load(spark, "flags")


def q_masked(spark, sf_dir):
    cat, bt, _ = _tables(spark, sf_dir)
    clauses = cat.load(spark, "blood_tests_clauses")
    cols = bt.select("patientId", "cholesterol_total_value", "fibrinogen_value")
    return mask_by_clauses(cols, clauses, {"cholesterol_total_value": "consent_labs",
                                           "fibrinogen_value": "consent_labs"},
                           drop_denied=True)


GOVERNED_SQL = (
    "SELECT blood_tests.patientId, "
    "CASE WHEN clauses.consent_labs THEN blood_tests.cholesterol_total_value END "
    "AS cholesterol_total_value, "
    "CASE WHEN clauses.consent_labs THEN blood_tests.fibrinogen_value END AS fibrinogen_value, "
    "CASE WHEN clauses.consent_identity THEN blood_tests.date END AS date "
    "FROM blood_tests LEFT JOIN clauses ON blood_tests.patientId = clauses.patientId"
)


def q_governed(spark, sf_dir):
    plan = GovernedPlan(sql=GOVERNED_SQL, tables=("blood_tests", "blood_tests_clauses"))
    return run_governed(spark, plan, fixture_catalog(sf_dir))


RESEARCH_QUERY = "SELECT patientId, cholesterol_total_value, fibrinogen_value, date FROM blood_tests"


def research_policy(request: PolicyRequest) -> GovernedPlan | None:
    """Stand-in for the external policy engine: for research reads of the
    measurement table it answers with the consent-masked rewrite."""
    if request.purpose == "research" and request.query == RESEARCH_QUERY:
        return GovernedPlan(sql=GOVERNED_SQL, tables=("blood_tests", "blood_tests_clauses"))
    return None


def q_governed_query(spark, sf_dir):
    return governed_query(spark, RESEARCH_QUERY, "research", research_policy,
                          fixture_catalog(sf_dir))


# A governed read of measurements, profiles and consent: the first
# measurements of the people born in a range of years.
GOVERNED_JOIN_SQL = (
    "SELECT blood_tests.testId, blood_tests.patientId, patientsProfiles.gender, "
    "CASE WHEN clauses.consent_labs THEN blood_tests.fibrinogen_value END AS fibrinogen_value "
    "FROM blood_tests JOIN patientsProfiles ON patientsProfiles.patientId = blood_tests.patientId "
    "LEFT JOIN clauses ON clauses.patientId = blood_tests.patientId "
    "WHERE patientsProfiles.birthDate >= make_date({first}, 1, 1) "
    "AND patientsProfiles.birthDate < make_date({after}, 1, 1) "
    "ORDER BY blood_tests.testId LIMIT {most}"
)
JOIN_ARGS = {"first": 1960, "after": 1990, "most": TOP_K}


def q_governed_join(spark, sf_dir):
    plan = GovernedPlan(sql=GOVERNED_JOIN_SQL.format(**{a: f":{a}" for a in JOIN_ARGS}),
                        tables=("blood_tests", "patientsProfiles", "blood_tests_clauses"))
    return run_governed(spark, plan, fixture_catalog(sf_dir), args=JOIN_ARGS)


def export_policy(request: PolicyRequest) -> GovernedPlan | None:
    """Stand-in for the external policy engine: movements to the public cloud
    may read and write; laboratory values and genders need consent."""
    if request.purpose != "data_movement_public_cloud" or request.access not in ("read", "write"):
        return None
    return GovernedPlan(sql=request.query, tables=(), rules={
        "fibrinogen_value": "consent_labs", "cholesterol_total_value": "consent_labs",
        "gender": "consent_identity"})


def q_governed_public_export(spark, sf_dir):
    folder, purpose = _folder(spark), "data_movement_public_cloud"
    stage_governed_export(spark, fixture_catalog(sf_dir), f"{folder}/staging", purpose, export_policy)
    finish_governed(spark, f"{folder}/staging", f"{folder}/target", purpose, export_policy, fill={})
    return spark.read.parquet(f"{folder}/target")


# Groups of at least K rows in the export, at the price of few rows.
QUASI_IDENTIFIERS = (keep_or_hide("gender"), year_bands("birthDate"), calendar("date"))
K, MAX_SHARE = 100, 0.15


def q_k_anonymous_export(spark, sf_dir):
    rows, _ = anonymous(_export(spark, sf_dir), QUASI_IDENTIFIERS, K, MAX_SHARE)
    return rows


def q_k_anonymous_report(spark, sf_dir):
    # what was chosen, and the groups of the rows that left, counted anew
    rows, made = anonymous(_export(spark, sf_dir), QUASI_IDENTIFIERS, K, MAX_SHARE)
    groups = quasi_identifier_groups(rows, [h.column for h in QUASI_IDENTIFIERS])
    return (groups.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("rows_left"), F.min("n").alias("smallest"))
            .withColumn("levels", F.lit(",".join(map(str, made.levels))))
            .withColumn("suppressed", F.lit(made.suppressed).cast("long")))


def q_generalise(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    return generalise_birth_date(pp.select("patientId", "gender", "birthDate"))


def q_pseudonym_sha2(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    return pseudonymise_id(pp.select("socialId", "patientId"), "socialId", method="sha2")


# A demonstration key: the oracle needs the same one. Deployments take theirs
# from a keystore, as the round trip does.
DEMO_KEY = "demonstration key"


def q_keyed_pseudonyms(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return pseudonymise(bt.select("testId", "patientId"), "patientId", DEMO_KEY)


def q_keyed_mac(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    return pseudonymise(pp.select("socialId", "patientId"), "socialId", DEMO_KEY, method="mac")


def q_keyed_round_trip(spark, sf_dir):
    # measurements and profiles joined by pseudonyms, the ids then restored
    folder, (_, bt, pp) = _folder(spark), _tables(spark, sf_dir)
    create_keystore(spark, f"{folder}/keys", ["ids"])
    key = keystore_key(spark, f"{folder}/keys", "ids")
    tests, people = (pseudonymise(df, "patientId", key) for df in (bt.select("testId", "patientId"),
                                                                   pp.select("patientId", "gender")))
    return restore_ids(tests_with_profiles(tests, people), "patientId", key)


def q_pseudonym_murmur3(spark, sf_dir):
    # the reference's private-zone hash, for whole numbers and for texts
    _, _, pp = _tables(spark, sf_dir)
    both = pp.select("patientId", F.col("patientId").alias("number"), F.col("socialId").alias("text"))
    return pseudonymise_id(pseudonymise_id(both, "number", method="murmur3"), "text", method="murmur3")


def q_fill(spark, sf_dir):
    _, bt, _ = _tables(spark, sf_dir)
    return fill_present(bt.select("testId", "fibrinogen_value"), {"fibrinogen_value": 0.0})


def q_id_only(spark, sf_dir):
    _, _, pp = _tables(spark, sf_dir)
    return drop_denied_rows(pp.select("patientId"))


# The same tables with a subject who holds a third of all measurements and
# with measurements of nobody; the policy makes both hot at any size.
HOT_ID = ("CASE WHEN testId % 3 = 0 THEN 7 WHEN testId % 50 = 1 THEN NULL "
          "ELSE patientId END")
HOT_SKEW = SkewPolicy(rows_per_task=100)


def _hot_tables(spark, sf_dir):
    cat, bt, pp = _tables(spark, sf_dir)
    return cat, bt.withColumn("patientId", F.expr(HOT_ID)), pp


def q_hot_masked(spark, sf_dir):
    cat, bt, _ = _hot_tables(spark, sf_dir)
    cols = bt.select("patientId", "cholesterol_total_value", "fibrinogen_value")
    return mask_by_clauses(cols, cat.load(spark, "blood_tests_clauses"),
                           {"cholesterol_total_value": "consent_labs",
                            "fibrinogen_value": "consent_labs"}, skew=HOT_SKEW)


# Three cohorts of the measurements, and what is asked of them.
COHORTS = {"stroke": "stroke = 1", "high": "fibrinogen_value > 200", "heavy": "bmi >= 37 AND haemoglobin_value > 100"}


def _cohort_index(spark, sf_dir):
    """The index, stored once and read back as its readers find it."""
    folder, (_, bt, _) = _folder(spark), _tables(spark, sf_dir)
    cohort_index(bt, COHORTS).write.parquet(f"{folder}/index")
    return bt, spark.read.parquet(f"{folder}/index")


_STROKE, _HIGH, _HEAVY = (Cohort.named(n) for n in COHORTS)


def q_cohort_algebra(spark, sf_dir):
    _, index = _cohort_index(spark, sf_dir)
    return cohort_ids(members(index, (_STROKE | _HIGH) - _HEAVY))


def q_cohort_sizes(spark, sf_dir):
    _, index = _cohort_index(spark, sf_dir)
    asked = {"stroke": _STROKE, "stroke and heavy": _STROKE & _HEAVY, "none": ~(_STROKE | _HIGH | _HEAVY),
             "two or more": (_STROKE & _HIGH) | (_STROKE & _HEAVY) | (_HIGH & _HEAVY)}
    sizes = [cohort_size(members(index, c)).withColumn("cohort", F.lit(n)) for n, c in asked.items()]
    return functools.reduce(DataFrame.unionByName, sizes)


def q_bitmap_in_cohort(spark, sf_dir):
    bt, index = _cohort_index(spark, sf_dir)
    return rows_in(bt.select("testId", "patientId"), members(index, _STROKE))


def q_bitmap_not_in_cohort(spark, sf_dir):
    bt, index = _cohort_index(spark, sf_dir)
    return rows_in(bt.select("testId", "patientId"), members(index, _STROKE | _HIGH), negate=True)


BUCKETS = 16


def _laid_out(spark, sf_dir):
    """The hot measurements and the per-subject tables, in equal buckets."""
    folder, (cat, bt, pp) = _folder(spark), _hot_tables(spark, sf_dir)
    tests = write_bucketed(bt, f"{folder}/tests", "patientId", BUCKETS, HOT_SKEW)
    keyed = [write_bucketed(df, f"{folder}/{n}", "patientId", BUCKETS, skew=None).read(spark)
             for n, df in (("profiles", pp), ("clauses", cat.load(spark, "blood_tests_clauses")))]
    return tests, *keyed


def q_bucketed_profiles(spark, sf_dir):
    tests, profiles, _ = _laid_out(spark, sf_dir)
    return tests.over_parts(spark, lambda rows, skew, hot: tests_with_profiles(
        rows, profiles, skew=skew, hot=hot), HOT_SKEW)


def q_bucketed_masked(spark, sf_dir):
    tests, _, clauses = _laid_out(spark, sf_dir)
    rules = {"cholesterol_total_value": "consent_labs", "fibrinogen_value": "consent_labs"}
    return tests.over_parts(spark, lambda rows, skew, hot: mask_by_clauses(
        rows.select("patientId", *rules), clauses, rules, skew=skew, hot=hot), HOT_SKEW)


def q_hot_not_in_cohort(spark, sf_dir):
    _, bt, _ = _hot_tables(spark, sf_dir)
    return not_in_cohort(bt.select("testId", "patientId"), stroke_cohort(bt), skew=HOT_SKEW)


def q_hot_public_export(spark, sf_dir):
    _, bt, pp = _hot_tables(spark, sf_dir)
    return public_export(bt, pp, skew=HOT_SKEW)


# The tables with the faults of real ones: measurements of nobody (also among
# the flagged ones), people without a profile, birth dates as texts of which
# some are no dates, and values that are not a number.
ROUGH_ID = "CASE WHEN testId % 50 = 1 OR testId % 194 = 0 THEN NULL ELSE patientId END"
ROUGH_VALUE = "CASE WHEN testId % 12 = 0 THEN CAST('NaN' AS DOUBLE) ELSE fibrinogen_value END"
ROUGH_BIRTH = ("CASE WHEN patientId % 7 = 0 THEN 'unknown' WHEN patientId % 11 = 0 THEN NULL "
               "ELSE CAST(birthDate AS VARCHAR(10)) END")
ROUGH_PROFILES = "patientId % 10 <> 0"


def _rough_tables(spark, sf_dir):
    _, bt, pp = _tables(spark, sf_dir)
    return (bt.withColumn("fibrinogen_value", F.expr(ROUGH_VALUE)).withColumn("patientId", F.expr(ROUGH_ID)),
            pp.where(ROUGH_PROFILES).withColumn("birthDate", F.expr(ROUGH_BIRTH)))


def _nan_apart(export: DataFrame) -> DataFrame:
    """NaN as a column of its own: it has no SQL text that compares equal."""
    nan = F.isnan("fibrinogen_value")
    return export.withColumns({"not_a_number": nan, "fibrinogen_value": F.when(~nan, F.col("fibrinogen_value"))})


def q_rough_public_export(spark, sf_dir):
    bt, pp = _rough_tables(spark, sf_dir)
    return _nan_apart(public_export(bt, pp))


def q_rough_export_strict(spark, sf_dir):
    # a NULL id in the cohort: NOT IN holds for nobody
    bt, pp = _rough_tables(spark, sf_dir)
    return _nan_apart(public_export(bt, pp, null_ids="strict"))


def q_rough_not_in_strict(spark, sf_dir):
    bt, _ = _rough_tables(spark, sf_dir)
    cohort, hot = cohort_and_hot_keys(bt, None, "patientId", DEFAULT_SKEW)
    return not_in_cohort(bt.select("testId", "patientId"), cohort, null_ids="strict",
                         hot=hot).agg(F.count("*").alias("n"))


def q_rough_generalise(spark, sf_dir):
    _, pp = _rough_tables(spark, sf_dir)
    return generalise_birth_date(pp.select("patientId", "birthDate"))


def q_rough_age_band(spark, sf_dir):
    bt, pp = _rough_tables(spark, sf_dir)
    return age_band_values(bt, pp, "cholesterol", *AGE_BAND, as_of=AS_OF)


def q_rough_no_id(spark, sf_dir):
    bt, _ = _rough_tables(spark, sf_dir)
    kept = drop_denied_rows(bt.select("patientId", "fibrinogen_value"), subject=None)
    return kept.select("patientId", F.isnan("fibrinogen_value").alias("not_a_number"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "component_series": q_component_series,
    "component_series_measured": q_component_series_measured,
    "avg_age": q_avg_age,
    "age_band_values": q_age_band_values,
    "json_average": q_json_average,
    "json_rows": q_json_rows,
    "variant_average": q_variant_average,
    "variant_texts": q_variant_texts,
    "partial_averages": q_partial_averages,
    "patient_details": q_patient_details,
    "patient_details_private": q_patient_details_private,
    "documents": q_documents,
    "nutritional": q_nutritional,
    "nutritional_private": q_nutritional_private,
    "nutritional_top20": q_nutritional_top20,
    "stroke_cohort": q_stroke_cohort,
    "cohort_algebra": q_cohort_algebra,
    "cohort_sizes": q_cohort_sizes,
    "bitmap_in_cohort": q_bitmap_in_cohort,
    "bitmap_not_in_cohort": q_bitmap_not_in_cohort,
    "in_cohort": q_in_cohort,
    "not_in_cohort": q_not_in_cohort,
    "tests_with_profiles": q_tests_with_profiles,
    "public_export": q_public_export,
    "public_export_all": q_public_export_all,
    "public_export_strict": q_public_export_strict,
    "public_export_where": q_public_export_where,
    "public_export_top20": q_public_export_top20,
    "public_tests": q_public_tests,
    "movement_round_trip": q_movement_round_trip,
    "movement_rerun": q_movement_rerun,
    "movement_refused": q_movement_refused,
    "movement_report": q_movement_report,
    "movement_emptied": q_movement_emptied,
    "movement_altered_stage": q_movement_altered_stage,
    "movement_digest": q_movement_digest,
    "sealed_movement": q_sealed_movement,
    "sealed_masked": q_sealed_masked,
    "governed_lineage": q_governed_lineage,
    "catalog_append": q_catalog_append,
    "governed_join": q_governed_join,
    "governed_public_export": q_governed_public_export,
    "rough_public_export": q_rough_public_export,
    "rough_export_strict": q_rough_export_strict,
    "rough_not_in_strict": q_rough_not_in_strict,
    "rough_generalise": q_rough_generalise,
    "rough_age_band": q_rough_age_band,
    "rough_no_id": q_rough_no_id,
    "public_cohort": q_public_cohort,
    "public_avg_age": q_public_avg_age,
    "birth_year_int": q_birth_year_int,
    "public_group_sizes": q_public_group_sizes,
    "masked": q_masked,
    "governed": q_governed,
    "governed_query": q_governed_query,
    "k_anonymous_export": q_k_anonymous_export,
    "k_anonymous_report": q_k_anonymous_report,
    "generalise": q_generalise,
    "pseudonym_sha2": q_pseudonym_sha2,
    "pseudonym_murmur3": q_pseudonym_murmur3,
    "keyed_pseudonyms": q_keyed_pseudonyms,
    "keyed_mac": q_keyed_mac,
    "keyed_round_trip": q_keyed_round_trip,
    "fill": q_fill,
    "id_only": q_id_only,
    "hot_masked": q_hot_masked,
    "bucketed_profiles": q_bucketed_profiles,
    "bucketed_masked": q_bucketed_masked,
    "hot_not_in_cohort": q_hot_not_in_cohort,
    "hot_public_export": q_hot_public_export,
}


# The training-data operators and their pipeline are an optional part: the
# queries above work without it.
try:
    import corpus_pipeline
    from custodia.llm.oracles import ORACLE_SQL as _LLM_ORACLE
    from custodia.llm.queries import QUERIES as _LLM_QUERIES
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("corpus_pipeline", "custodia.llm")):
        raise
    _LLM_QUERIES, _LLM_ORACLE = {}, {}
else:
    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": corpus_pipeline.run}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the anonymised public-zone export on sf0.001."""
    return q_public_export(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_LLM_QUERIES}


# --------------------------------------------------------------------------
# DuckDB oracle: the same derivations as CTEs over the driver's tables
# --------------------------------------------------------------------------

def _blood_tests_sql() -> str:
    return "SELECT " + ", ".join(blood_tests_expressions()) + " FROM events"


_PROFILES_SQL = ("SELECT " + ", ".join(PROFILE_EXPRESSIONS)
                 + " FROM customer JOIN nation ON c_nationkey = n_nationkey")
_CLAUSES_SQL = "SELECT " + ", ".join(CLAUSE_EXPRESSIONS) + " FROM customer"
_DOCUMENTS_SQL = "SELECT " + ", ".join(DOCUMENT_EXPRESSIONS) + " FROM documents"

_WITH = (
    f"WITH blood_tests AS ({_blood_tests_sql()}), "
    f"patientsProfiles AS ({_PROFILES_SQL}), "
    f"clauses AS ({_CLAUSES_SQL}), "
    f"documents_p AS ({_DOCUMENTS_SQL}) "
)

_J = "blood_tests INNER JOIN patientsProfiles ON patientsProfiles.patientId = blood_tests.patientId"
_IDS = "(SELECT DISTINCT patientId FROM blood_tests WHERE stroke = 1)"


def _export_sql(distinct: bool = True, where: str = "TRUE",
                birth: str = "CAST(year(p.birthDate) AS INT)") -> str:
    """The export by its meaning: a subject has had a stroke if any of
    their measurements says so; each measurement row of a subject with a
    profile leaves without its id and with the year of birth."""
    columns = ", ".join(f"m.{c}" for c in MEASUREMENT_COLUMNS)
    return (
        f"(SELECT {'DISTINCT' if distinct else ''} CAST(coalesce(h.had, FALSE) AS INT) AS stroke, "
        f"0 AS patientId, p.gender, {birth} AS birthDate, "
        f"{columns} FROM (SELECT * FROM blood_tests WHERE category = 'blood_test' AND {where}) m "
        "JOIN patientsProfiles p USING (patientId) "
        "LEFT JOIN (SELECT patientId, bool_or(stroke = 1) AS had FROM blood_tests GROUP BY patientId) h "
        "USING (patientId))"
    )


_BAND_PRIVATE = "patientsProfiles.birthDate >= DATE '1960-01-01' AND patientsProfiles.birthDate < DATE '1990-01-01'"
_BAND_PUBLIC = "birthDate > 1960 AND birthDate < 1990"
_NUTRITION = ("blood_tests.cholesterol_total_value, blood_tests.cholesterol_ldl_value, "
              "blood_tests.patientId, blood_tests.bmi, blood_tests.category, "
              "patientsProfiles.birthDate, patientsProfiles.gender")
# private zone: the birth date leaves as a year
_NUTRITION_PRIVATE = _NUTRITION.replace(
    "patientsProfiles.birthDate", "CAST(year(patientsProfiles.birthDate) AS INT) AS birthDate")
_MASK = ("SELECT b.patientId, CASE WHEN cl.consent_labs THEN b.cholesterol_total_value END "
         "AS cholesterol_total_value, CASE WHEN cl.consent_labs THEN b.fibrinogen_value END "
         "AS fibrinogen_value FROM blood_tests b LEFT JOIN clauses cl ON b.patientId = cl.patientId")

_ORACLE = {
    "component_series":
        "SELECT patientId, date, cholesterol_total_value FROM blood_tests "
        "WHERE date IS NOT NULL OR cholesterol_total_value IS NOT NULL",
    "component_series_measured":
        "SELECT patientId, date, cholesterol_total_value FROM blood_tests "
        "WHERE cholesterol_total_value IS NOT NULL",
    "avg_age":
        f"SELECT round(avg(blood_tests.fibrinogen_value), 6) AS value FROM {_J} WHERE {_BAND_PRIVATE}",
    "age_band_values":
        f"SELECT blood_tests.fibrinogen_value, blood_tests.patientId FROM {_J} "
        f"WHERE {_BAND_PRIVATE} AND blood_tests.fibrinogen_value IS NOT NULL",
    "patient_details":
        f"SELECT {', '.join(PROFILE_COLUMNS)} FROM patientsProfiles WHERE socialId = '{SOCIAL_ID}'",
    "patient_details_private":
        f"SELECT {', '.join(PROFILE_COLUMNS)} FROM (SELECT * REPLACE (sha256(socialId) AS socialId, "
        f"CAST(year(birthDate) AS INT) AS birthDate) FROM patientsProfiles) p WHERE socialId = sha256('{SOCIAL_ID}')",
    "documents": f"SELECT * FROM documents_p WHERE patientId = {PATIENT}",
    "nutritional":
        f"SELECT {_NUTRITION} FROM {_J} WHERE blood_tests.category = 'blood_test' "
        f"AND blood_tests.patientId IN {_IDS}",
    "nutritional_private":
        f"SELECT {_NUTRITION_PRIVATE} FROM {_J} WHERE blood_tests.category = 'blood_test' AND blood_tests.patientId IN {_IDS}",
    "nutritional_top20":
        f"SELECT {_NUTRITION} FROM {_J} WHERE blood_tests.category = 'blood_test' "
        f"AND blood_tests.patientId IN {_IDS} ORDER BY blood_tests.testId LIMIT {TOP_K}",
    "stroke_cohort": "SELECT DISTINCT patientId FROM blood_tests WHERE stroke = 1",
    "in_cohort": f"SELECT patientId, testId FROM blood_tests WHERE patientId IN {_IDS}",
    "not_in_cohort": f"SELECT patientId, testId FROM blood_tests WHERE patientId NOT IN {_IDS}",
    "tests_with_profiles":
        f"SELECT blood_tests.*, {', '.join(c for c in PROFILE_COLUMNS if c != 'patientId')} FROM {_J}",
    "public_export": _export_sql(),
    "public_export_all": _export_sql(distinct=False),
    "public_export_strict": _export_sql(),
    "public_export_where": _export_sql(where="fibrinogen_value IS NOT NULL"),
    "public_cohort":
        "SELECT cholesterol_total_value, cholesterol_ldl_value, patientId, bmi, category, "
        f"birthDate, gender FROM ({_export_sql()}) p WHERE category = 'blood_test' AND stroke = 1",
    "public_avg_age":
        f"SELECT round(avg(fibrinogen_value), 6) AS value FROM ({_export_sql()}) p WHERE {_BAND_PUBLIC}",
    "birth_year_int":
        f"SELECT fibrinogen_value, patientId FROM ({_export_sql()}) p "
        f"WHERE {_BAND_PUBLIC} AND fibrinogen_value IS NOT NULL",
    "public_group_sizes":
        f"SELECT gender, birthDate, count(*) AS n FROM ({_export_sql()}) p GROUP BY gender, birthDate",
    "masked":
        f"SELECT * FROM ({_MASK}) t WHERE cholesterol_total_value IS NOT NULL "
        "OR fibrinogen_value IS NOT NULL",
    "governed":
        f"SELECT * FROM ({GOVERNED_SQL}) t WHERE cholesterol_total_value IS NOT NULL "
        "OR fibrinogen_value IS NOT NULL OR date IS NOT NULL",
    "generalise":
        "SELECT patientId, gender, CAST(year(birthDate) AS INT) AS birthDate FROM patientsProfiles",
    "pseudonym_sha2": "SELECT sha256(socialId) AS socialId, patientId FROM patientsProfiles",
    "fill":
        "SELECT testId, coalesce(fibrinogen_value, CAST(0.0 AS DOUBLE)) AS fibrinogen_value "
        "FROM blood_tests",
    "id_only": "SELECT patientId FROM patientsProfiles",
}
# The query-service path (policy -> plan -> run -> row filters) gives the
# governed rows; the all-NULL filter changes nothing for this result.
_ORACLE["governed_query"] = _ORACLE["governed"]
# Rows as JSON texts, built field by field: Spark omits NULL fields, so
# each optional field is appended only when present.
_ORACLE["json_rows"] = (
    "SELECT '{' || '\"patientId\":' || CAST(patientId AS VARCHAR) "
    "|| CASE WHEN date IS NOT NULL THEN ',\"date\":\"' || strftime(date, '%Y-%m-%d') || '\"' "
    "ELSE '' END "
    "|| CASE WHEN cholesterol_total_value IS NOT NULL THEN ',\"cholesterol_total_value\":' "
    "|| CAST(cholesterol_total_value AS VARCHAR) ELSE '' END || '}' AS value "
    "FROM blood_tests WHERE date IS NOT NULL OR cholesterol_total_value IS NOT NULL"
)
# The JSON round trip must give the same average as the typed path.
_ORACLE["json_average"] = _ORACLE["avg_age"]


_ORACLE["variant_average"] = _ORACLE["avg_age"]
_ORACLE["variant_texts"] = (
    "SELECT testId, testId % 7 <> 0 AND (testId % 11 = 0 OR testId % 13 = 0 OR testId % 17 <> 0) AS parsed, "
    "CASE WHEN testId % 7 <> 0 AND testId % 11 <> 0 AND testId % 13 <> 0 AND testId % 17 <> 0 THEN fibrinogen_value END "
    "AS fibrinogen_value FROM blood_tests WHERE fibrinogen_value IS NOT NULL")
_ORACLE["partial_averages"] = " UNION ALL ".join(
    f"SELECT '{c}' AS component, count({c}_value) AS n, round(avg({c}_value), 6) AS value FROM {_export_sql()} p "
    f"WHERE {_BAND_PUBLIC} AND (stroke = 1 OR bmi > 25) HAVING count({c}_value) > 0" for c in COMPONENTS)


_WITH_HOT = _WITH.replace(
    f"blood_tests AS ({_blood_tests_sql()})",
    f"even_tests AS ({_blood_tests_sql()}), "
    f"blood_tests AS (SELECT * REPLACE ({HOT_ID} AS patientId) FROM even_tests)")
_HOT = {
    "hot_masked": _MASK,
    "hot_not_in_cohort":
        "SELECT patientId, testId FROM blood_tests b WHERE NOT EXISTS "
        "(SELECT 1 FROM blood_tests s WHERE s.stroke = 1 AND s.patientId = b.patientId)",
    "hot_public_export": _export_sql(),
    "bucketed_profiles": _ORACLE["tests_with_profiles"],
    "bucketed_masked": _MASK,
}
_ORACLE.update(_HOT)


_FILLED = "SELECT * REPLACE (coalesce(fibrinogen_value, CAST(0.0 AS DOUBLE)) AS fibrinogen_value) FROM"
_ORACLE.update({
    "public_export_top20": f"SELECT * FROM {_export_sql()} p ORDER BY "
                           + ", ".join(f"{c} NULLS FIRST" for c in PUBLIC_COLUMNS) + f" LIMIT {TOP_K}",
    "public_tests": _export_sql(),
    "movement_round_trip": f"{_FILLED} {_export_sql()} p",
    "movement_rerun": f"{_FILLED} {_export_sql()} p WHERE stroke = 1",
    "movement_refused": "SELECT testId, fibrinogen_value FROM blood_tests WHERE fibrinogen_value IS NOT NULL",
    "movement_report": f"SELECT 'all' AS step, count(*) AS moved, count(*) = 0 AS empty FROM {_export_sql()} p "
                       "UNION ALL SELECT 'nobody', 0, TRUE",
    "catalog_append": "SELECT testId, patientId, stroke FROM blood_tests",
    "governed_join": GOVERNED_JOIN_SQL.format(**JOIN_ARGS),
})

_FLAGS = ("SELECT patientId, " + ", ".join(f"coalesce(bool_or({c}), FALSE) AS {n}" for n, c in COHORTS.items())
          + " FROM blood_tests WHERE patientId IS NOT NULL GROUP BY patientId")
_ORACLE.update({
    "cohort_algebra": f"SELECT patientId FROM ({_FLAGS}) f WHERE (stroke OR high) AND NOT heavy",
    "cohort_sizes": " UNION ALL ".join(
        f"SELECT '{name}' AS cohort, count(*) AS n FROM ({_FLAGS}) f WHERE {rule}" for name, rule in (
            ("stroke", "stroke"), ("stroke and heavy", "stroke AND heavy"),
            ("none", "NOT stroke AND NOT high AND NOT heavy"),
            ("two or more", "CAST(stroke AS INT) + CAST(high AS INT) + CAST(heavy AS INT) >= 2"))),
    "bitmap_in_cohort": _ORACLE["in_cohort"],
    "bitmap_not_in_cohort": f"SELECT patientId, testId FROM blood_tests b WHERE NOT EXISTS "
                            f"(SELECT 1 FROM ({_FLAGS}) f WHERE f.patientId = b.patientId AND (stroke OR high))",
})
_MOVED = "SELECT testId, patientId, stroke, fibrinogen_value FROM blood_tests"
_GOVERNED = _ORACLE["governed"]


def _framed(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(strlen({text}) AS VARCHAR) || ':' || {text} END"


_LIMBS = " || ':' || ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)) AS VARCHAR)" for k in range(4))
_CONTENTS = (f"SELECT count(*) AS rows, {_LIMBS} AS digest FROM (SELECT sha256("
             + " || ".join(_framed(c) for c in sorted(["testId", "patientId", "date", "stroke"]))
             + ") AS h FROM blood_tests)")
_ORACLE.update({
    "movement_emptied": f"SELECT t.*, 'm2' AS movement_id FROM ({_MOVED}) t WHERE testId % 5 = 0",
    "movement_altered_stage": f"{_MOVED} WHERE testId % 2 = 0",
    "movement_digest": f"SELECT s.step, c.rows, c.digest FROM ({_CONTENTS}) c, "
                       "(VALUES ('staged'), ('moved'), ('target')) s(step)",
    "sealed_movement": f"{_FILLED} ({_GOVERNED}) t",
    "sealed_masked": "SELECT patientId, CAST(NULL AS DOUBLE) AS cholesterol_total_value, "
                     f"CAST(NULL AS DOUBLE) AS fibrinogen_value, CAST(NULL AS DATE) AS date FROM ({_GOVERNED}) t",
    "governed_lineage": "SELECT s.*, CASE s.\"column\" WHEN 'patientId' THEN n.p WHEN 'date' THEN n.d "
                        "WHEN 'fibrinogen_value' THEN n.f ELSE n.c END AS cells FROM "
                        "(SELECT count(patientId) AS p, count(date) AS d, count(fibrinogen_value) AS f, "
                        f"count(cholesterol_total_value) AS c FROM ({_GOVERNED}) t) n, (VALUES "
                        "('patientId', 'blood_tests', 'patientId'), ('date', 'blood_tests', 'date'), "
                        "('date', 'blood_tests_clauses', 'consent_identity'), "
                        "('fibrinogen_value', 'blood_tests', 'fibrinogen_value'), "
                        "('fibrinogen_value', 'blood_tests_clauses', 'consent_labs'), "
                        "('cholesterol_total_value', 'blood_tests', 'cholesterol_total_value'), "
                        "('cholesterol_total_value', 'blood_tests_clauses', 'consent_labs')) "
                        "s(\"column\", source_table, source_column)",
})

# The Feistel network of the keyed pseudonyms, a step per round. Both halves
# are whole numbers below 2 ** 32; the result is read as a signed number.
_FEISTEL = ["SELECT testId, (patientId >> 32) & 4294967295 AS l, patientId & 4294967295 AS r FROM blood_tests"] + [
    f"SELECT testId, r AS l, xor(l, CAST('0x' || substr(sha256('{DEMO_KEY}|{n}|' || CAST(r AS VARCHAR)), 1, 8) "
    f"AS BIGINT)) AS r FROM feistel{n - 1}" for n in range(1, 11)]


def _hmac(text: str, key: str) -> str:
    """HMAC-SHA-256 with a short ASCII key, its padding written out."""
    inner, outer = ("".join(f"\\x{(key.encode()[k] if k < len(key) else 0) ^ pad:02X}" for k in range(64))
                    for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({text}))))"


def _murmur3(words: str, size: str) -> str:
    """Murmur3 (32 bits, seed 42) of a list of words; numbers are kept below
    2 ** 32 and the result is read as a signed one."""
    def times(x: str, c: int) -> str:
        return f"CAST(({x})::HUGEINT * {c} % 4294967296 AS BIGINT)"

    def turned(x: str, n: int) -> str:
        return f"(((({x}) << {n}) & 4294967295) | (({x}) >> {32 - n}))"

    def folded(x: str, n: int) -> str:
        return f"xor({x}, ({x}) >> {n})"
    word = times(turned(times("k", 0xCC9E2D51), 15), 0x1B873593)
    step = f"({times(turned(f'xor(h, {word})', 13), 5)} + 3864292196) & 4294967295"
    mixed = f"xor(list_reduce(list_prepend(42::BIGINT, {words}), lambda h, k: {step}), {size})"
    end = folded(times(folded(times(folded("m", 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)
    end = f"list_transform([{mixed}], lambda m: {end})[1]"
    return f"CAST(list_transform([{end}], lambda m: CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END)[1] AS INT)"


def _byte(text: str, at: str) -> str:
    return f"CAST('0x' || substr(hex(encode({text})), CAST(2 * ({at}) + 1 AS BIGINT), 2) AS BIGINT)"


def _text_words(text: str) -> str:
    """Four bytes a word, the first the lowest; the bytes left over are words
    of their own, as signed numbers."""
    whole = " + ".join(f"{_byte(text, f'4 * i + {k}')} * {256 ** k}" for k in range(4))
    rest = f"{_byte(text, 'i')} + CASE WHEN {_byte(text, 'i')} >= 128 THEN 4294967040 ELSE 0 END"
    n = f"CAST(strlen({text}) AS BIGINT)"
    return (f"list_concat(list_transform(range({n} // 4), lambda i: {whole}), "
            f"list_transform(range({n} // 4 * 4, {n}), lambda i: {rest}))")


_ORACLE["pseudonym_murmur3"] = (
    f"SELECT patientId, {_murmur3('[patientId & 4294967295, (patientId >> 32) & 4294967295]', '8')} AS number, "
    f"{_murmur3(_text_words('socialId'), 'strlen(socialId)')} AS text FROM patientsProfiles")
_ORACLE.update({
    "keyed_pseudonyms": "SELECT testId, CASE WHEN l >= 2147483648 THEN l - 4294967296 ELSE l END * 4294967296 + r "
                        "AS patientId FROM feistel10",
    "keyed_mac": f"SELECT {_hmac('socialId', DEMO_KEY)} AS socialId, patientId FROM patientsProfiles",
    "keyed_round_trip": f"SELECT blood_tests.patientId, blood_tests.testId, patientsProfiles.gender FROM {_J}",
})

def _anonymous_sql() -> str:
    """CTEs of the export at the lowest levels that satisfy K and MAX_SHARE:
    ``left_rows`` (recoded, with the rows of its group) and ``chosen``."""
    columns = [h.column for h in QUASI_IDENTIFIERS]
    judged = []
    for levels in itertools.product(*(range(len(h.levels)) for h in QUASI_IDENTIFIERS)):
        values = ", ".join(f"{h.levels[n].format(c=h.column)} AS v{j}"
                           for j, (h, n) in enumerate(zip(QUASI_IDENTIFIERS, levels)))
        numbers = ", ".join(f"{n} AS l{j}" for j, n in enumerate(levels))
        judged.append(f"SELECT {numbers}, sum(CASE WHEN n < {K} THEN n ELSE 0 END) AS suppressed, sum(n) AS total "
                      f"FROM (SELECT v0, v1, v2, sum(n) AS n FROM (SELECT {values}, n FROM finest) GROUP BY ALL)")
    recoded = ", ".join("CASE l{} {} END AS {}".format(j, " ".join(
        f"WHEN {n} THEN {level.format(c='e.' + h.column)}" for n, level in enumerate(h.levels)), h.column)
        for j, h in enumerate(QUASI_IDENTIFIERS))
    return (f", export AS {_export_sql()}, finest AS (SELECT {', '.join(columns)}, count(*) AS n FROM export GROUP BY ALL), "
            f"judged AS ({' UNION ALL '.join(judged)}), "
            f"chosen AS (SELECT * FROM judged WHERE suppressed <= {MAX_SHARE} * total "
            "ORDER BY l0 + l1 + l2, suppressed, l0, l1, l2 LIMIT 1), "
            f"recoded AS (SELECT e.* REPLACE ({recoded}) FROM export e, chosen), "
            f"left_rows AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(columns)}) AS members FROM recoded) ")


_ANONYMOUS = {
    "k_anonymous_export": f"SELECT * EXCLUDE (members) FROM left_rows WHERE members >= {K}",
    "k_anonymous_report":
        "SELECT count(*) AS n_groups, sum(n)::BIGINT AS rows_left, min(n) AS smallest, "
        "any_value(l0 || ',' || l1 || ',' || l2) AS levels, any_value(suppressed)::BIGINT AS suppressed FROM (SELECT "
        f"gender, birthDate, date, count(*) AS n FROM left_rows WHERE members >= {K} GROUP BY ALL) g, chosen",
}
_ORACLE.update(_ANONYMOUS)

_TESTS_CTE, _PROFILES_CTE = f"blood_tests AS ({_blood_tests_sql()})", f"patientsProfiles AS ({_PROFILES_SQL})"


def _with(tests: str, profiles: str) -> str:
    """The CTEs with changed measurements and profiles."""
    return (_WITH.replace(_TESTS_CTE, f"even_tests AS ({_blood_tests_sql()})")
            .replace(_PROFILES_CTE, f"even_profiles AS ({_PROFILES_SQL})").rstrip()
            + f", blood_tests AS ({tests}), patientsProfiles AS ({profiles}) ")


def _consented(column: str, consent: str) -> str:
    return f"CASE WHEN {consent} THEN {column} END AS {column}"


_CHANGED = {
    "governed_public_export": _with(
        "SELECT e.* REPLACE (" + ", ".join(_consented(c, "consent_labs") for c in
                                           ("fibrinogen_value", "cholesterol_total_value"))
        + ") FROM even_tests e LEFT JOIN clauses USING (patientId)",
        f"SELECT e.* REPLACE ({_consented('gender', 'consent_identity')}) "
        "FROM even_profiles e LEFT JOIN clauses USING (patientId)") + _export_sql(),
}
_ROUGH = _with(
    f"SELECT * REPLACE ({ROUGH_ID} AS patientId, {ROUGH_VALUE} AS fibrinogen_value) FROM even_tests",
    f"SELECT * REPLACE ({ROUGH_BIRTH} AS birthDate) FROM even_profiles WHERE {ROUGH_PROFILES}")
_ROUGH_EXPORT = _export_sql(birth="CAST(year(try_cast(p.birthDate AS DATE)) AS INT)")
_NAN_APART = ("SELECT * REPLACE (CASE WHEN NOT isnan(fibrinogen_value) THEN fibrinogen_value END AS fibrinogen_value), "
              "coalesce(isnan(fibrinogen_value), FALSE) AS not_a_number FROM")
_CHANGED |= {name: _ROUGH + sql for name, sql in {
    "rough_public_export": f"{_NAN_APART} {_ROUGH_EXPORT} p",
    "rough_export_strict": f"{_NAN_APART} {_ROUGH_EXPORT} p "
                           f"WHERE stroke = 1 OR NOT EXISTS (SELECT 1 FROM {_IDS} i WHERE i.patientId IS NULL)",
    "rough_not_in_strict": f"SELECT count(*) AS n FROM blood_tests WHERE patientId NOT IN {_IDS}",
    "rough_generalise": "SELECT patientId, CAST(year(try_cast(birthDate AS DATE)) AS INT) AS birthDate "
                        "FROM patientsProfiles",
    "rough_age_band": f"SELECT blood_tests.cholesterol_total_value, blood_tests.patientId FROM {_J} "
                      "WHERE year(try_cast(patientsProfiles.birthDate AS DATE)) BETWEEN 1960 AND 1989 "
                      "AND cholesterol_total_value IS NOT NULL",
    "rough_no_id": "SELECT patientId, coalesce(isnan(fibrinogen_value), FALSE) AS not_a_number "
                   "FROM blood_tests WHERE patientId IS NOT NULL OR fibrinogen_value IS NOT NULL",
}.items()}


_WITH_FEISTEL = _WITH.rstrip() + ", " + ", ".join(f"feistel{n} AS ({sql})" for n, sql in enumerate(_FEISTEL)) + " "


def _ctes(name: str) -> str:
    if name in _ANONYMOUS:
        return _WITH.rstrip() + _anonymous_sql()
    return _WITH_HOT if name in _HOT else _WITH_FEISTEL if name == "keyed_pseudonyms" else _WITH


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query key."""
    return {**{k: _ctes(k) + v for k, v in _ORACLE.items()},
            **_CHANGED, **_LLM_ORACLE}
