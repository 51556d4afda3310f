import pytest

from custodia.model import TableSpec
from custodia.sources.catalog import Catalog, parquet_catalog

from conftest import SF001


def test_parquet_catalog_loads_lazily(spark):
    cat = parquet_catalog(SF001, ["customer", "nation"])
    assert cat.load(spark, "nation").count() == 25
    with pytest.raises(KeyError):
        cat.load(spark, "patients")


def test_required_columns_checked(spark):
    cat = Catalog({"n": TableSpec("n", "parquet", f"{SF001}/nation.parquet",
                                  required_columns=("n_nationkey", "missing"))})
    with pytest.raises(ValueError):
        cat.load(spark, "n")


def test_save_append_and_derived_tables_are_read_only(spark, scratch):
    cat = Catalog({"t": TableSpec("t", "parquet", f"{scratch}/t")})
    df = spark.createDataFrame([(1,)], "x long")
    cat.save(df, "t")
    cat.save(df, "t")
    assert cat.load(spark, "t").count() == 2
    cat.register("d", lambda s: df)
    with pytest.raises(TypeError):
        cat.save(df, "d")


def _derby_available(spark) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
        return True
    except Exception:
        return False


def test_jdbc_round_trip_embedded_in_process(spark):
    """JDBC through an in-process, in-memory Derby database (no server, no
    port; the database is visible to this JVM only)."""
    if not _derby_available(spark):
        pytest.skip("no embedded JDBC driver on the classpath")
    url = "jdbc:derby:memory:custodia_test;create=true"
    opts = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    cat = Catalog({"patient": TableSpec("patient", "jdbc", "PATIENT", opts)})
    df = spark.createDataFrame([(1, "a"), (2, "b")], "patientId long, name string")
    cat.save(df, "patient", mode="overwrite")
    cat.save(df, "patient")
    assert cat.load(spark, "patient").count() == 4
    parallel = Catalog({"patient": TableSpec("patient", "jdbc", "PATIENT", {
        **opts, "partitionColumn": "patientId", "lowerBound": "1", "upperBound": "3",
        "numPartitions": "2"})})
    loaded = parallel.load(spark, "patient")
    assert loaded.rdd.getNumPartitions() == 2 and loaded.count() == 4


def test_catalog_from_location_and_type_maps(spark):
    cat = Catalog.from_maps(
        {"nation": f"{SF001}/nation.parquet", "patient": "PATIENT"},
        {"nation_type": "s3a", "patient_type": "jdbc"},
        {"url": "jdbc:derby:memory:x", "user": "u", "password": "p"})
    assert cat.load(spark, "nation").count() == 25
    spec = cat.spec("patient")
    assert spec.format == "jdbc" and spec.options["url"].startswith("jdbc:")
    parted = Catalog.from_maps({"patient": "PATIENT"}, {"patient_type": "jdbc"},
                               {"url": "jdbc:derby:memory:x"},
                               {"patient": {"partitionColumn": "patientId", "numPartitions": "8"}})
    assert parted.spec("patient").options["numPartitions"] == "8"
    with pytest.raises(KeyError):
        Catalog.from_maps({"t": "/x"}, {})
    with pytest.raises(ValueError):
        Catalog.from_maps({"t": "T"}, {"t_type": "jdbc"})


def test_declared_schema_is_used(spark):
    cat = Catalog({"n": TableSpec("n", "parquet", f"{SF001}/nation.parquet",
                                  schema="n_nationkey INT, n_name STRING")})
    df = cat.load(spark, "n")
    assert df.columns == ["n_nationkey", "n_name"] and df.count() == 25
