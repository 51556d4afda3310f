import math

from pyspark.sql import types as T

from custodia.operators import drop_denied_rows, json_component, to_json_rows

SCHEMA = T.StructType([
    T.StructField("patientId", T.LongType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.StringType()),
])


def test_drop_denied_keeps_rows_with_any_value_besides_subject(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, 1.0, None), (3, None, "x"), (None, None, None), (None, 2.0, None)],
        SCHEMA)
    got = sorted(r.patientId or -1 for r in drop_denied_rows(df).collect())
    assert got == [-1, 2, 3]


def test_drop_denied_nan_is_a_value(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, None, None)], SCHEMA)
    rows = drop_denied_rows(df).collect()
    assert len(rows) == 1 and math.isnan(rows[0].a)


def test_drop_denied_id_only_keeps_every_row_even_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "patientId long")
    assert drop_denied_rows(df).count() == 2


def test_drop_all_null_rows_without_subject(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None)], SCHEMA)
    assert drop_denied_rows(df, subject=None).count() == 1


def test_to_json_rows_omits_nulls_and_encodes_nan(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None), (2, float("nan"), None)], SCHEMA)
    texts = sorted(r.value for r in to_json_rows(df).collect())
    assert texts == sorted(['{"patientId":1,"b":"x"}', "{}", '{"patientId":2,"a":"NaN"}'])


def test_json_component_bad_text_is_null(spark):
    df = spark.createDataFrame([('{"v":"1.5"}',), ('{"v":"oops"}',), ("not json",), ('{"w":1}',)],
                               "value string")
    got = [r.v for r in json_component(df, "v").collect()]
    assert got == [1.5, None, None, None]


def test_variant_rows_round_trip_and_faulty_texts(spark, scratch):
    from custodia.operators import parse_variant_rows, to_variant_rows, variant_component

    df = spark.createDataFrame([(1, 0.1, "é"), (2, None, None), (3, float("inf"), "x")], "id long, `a b` double, t string")
    to_variant_rows(df).write.parquet(f"{scratch}/v")
    back = spark.read.parquet(f"{scratch}/v")
    assert back.dtypes == [("value", "variant")]
    for field, kind in (("id", "long"), ("a b", "double"), ("t", "string"), ("nothing", "int")):
        want = [None] * 3 if field == "nothing" else [r[0] for r in df.select(f"`{field}`").collect()]
        got = [r[0] for r in variant_component(back, field, kind).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    texts = ['{"v": 1.5}', '{"v": "1.25"}', '{"v": "word"}', '{"v": ', "", None, "[]", "{}", '{"v": null}', '{"v": 2, "w": [1]}']
    parsed = parse_variant_rows(spark.createDataFrame([(x,) for x in texts], "value string"))
    assert [r.v for r in variant_component(parsed, "v").collect()] == [1.5, 1.25, None, None, None, None, None, None, None, 2.0]
    assert [r.value is None for r in parsed.collect()] == [False] * 3 + [True] * 3 + [False] * 4
