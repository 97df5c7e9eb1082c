"""Scalar functions on hand-made rows."""

from pyspark.sql import functions as F

from staleguard.functions import arrays as A
from staleguard.functions import text as T
from staleguard.operators import windows as W


def one(spark, expr, schema="x string", rows=(("a",),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_normalize_strips_whitespace_and_punct(spark):
    rows = one(spark, T.normalize("x"), rows=[("\t Hello, World!\n",), ("?!.",)])
    assert [r.r for r in rows] == ["hello world", ""]


def test_derived_id_zero_fill_and_long_ids(spark):
    df = spark.createDataFrame([(46, 1), (4362, 3), (1234567, 1)], "i long, p int")
    got = [r.r for r in df.select(T.derived_id("i", F.col("p")).alias("r")).collect()]
    assert got == [100046, 304362, 11234567]


def test_prefix_date_order(spark):
    df = spark.createDataFrame([(400123,), (300001,), (100046,), (46,)], "i long")
    got = [str(r.r) for r in df.select(T.prefix_date("i").alias("r")).collect()]
    assert got == ["2010-01-01", "2015-01-01", "2005-01-01", "2000-01-01"]


def test_render_is_single_pass(spark):
    df = spark.createDataFrame([("contains {text2}", "B")], "a string, b string")
    got = df.select(T.render("1:{text1} 2:{text2}", text1="a", text2="b").alias("r")).collect()[0].r
    assert got == "1:contains {text2} 2:B"


def test_numbered_qa_format(spark):
    df = spark.createDataFrame([([("q1", "a1"), ("q2", "a2")],)], "qa array<struct<question:string,answer:string>>")
    got = df.select(T.numbered_qa("qa").alias("r")).collect()[0].r
    assert got == "question_1: q1\nanswer_1: a1\nquestion_2: q2\nanswer_2: a2\n"


def test_bool_mean_and_entity(spark):
    df = spark.createDataFrame([([True, False, True, True], None, "", "acme")],
                               "b array<boolean>, p string, c string, co string")
    r = df.select(A.bool_mean("b").alias("m"), T.first_entity("p", "c", "co").alias("e")).collect()[0]
    assert r.m == 0.75 and r.e == "acme"


def test_cumulative_select_thresholds(spark):
    df = spark.createDataFrame([(1, [0.5, 0.3, 0.2])], "id long, p array<double>")
    expect = {0.5: [0], 0.51: [0, 1], 0.9: [0, 1, 2], 2.0: [0, 1, 2], 0.0: [0]}
    for t, want in expect.items():
        got = W.cumulative_select(df, "id", "p", t).collect()[0].selected
        assert got == want, (t, got)


def test_overlap_is_false_not_null(spark):
    df = spark.createDataFrame([([1, None], [2])], "a array<bigint>, b array<bigint>")
    assert df.select(A.overlap_strict("a", "b").alias("r")).collect()[0].r is False
