"""F15 and F20 against Python's float."""

import math

from pyspark.sql import functions as F

from ringdata.functions import scalars as S

TEXTS = ["1", " 2.5\n", "\t9e3 ", "1.5d", "7f", "0x1p3", "1_000", "1__0", "_1", "1_", "1_.5", ".5", "5.", ".", "+.5e-3", "-0", "1e", "1e+", "1e5_0", "inf", "-Infinity", "nan", "1e999", "　９００００００００７\t", "٣٤", "९.५", "９．５", "＋1", "", " ", "1,5", "1 2", "½", "²", None, "\x1c7\x85", "1\x00", "١e٢", "True"]


def python(t):
    try:
        x = float(t)
        return x if math.isfinite(x) else -1.0
    except (TypeError, ValueError):
        return -1.0


def test_number_like_float(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", S.safe_number(F.col("t"), -1.0).alias("x")).collect()}
    assert {TEXTS[k]: x for k, x in got.items()} == {t: python(t) for t in TEXTS}


def test_columns_of_numbers_stay(spark):
    df = spark.createDataFrame([(1, 1.5, 7), (2, float("nan"), None), (3, float("-inf"), 70_000), (4, None, 0)], "k int, x double, p int")
    got = df.select("k", S.safe_number(F.col("x"), -1.0).alias("x"), S.valid_port(F.col("p")).alias("p")).orderBy("k").collect()
    assert [(r.x, r.p) for r in got] == [(1.5, 7), (-1.0, None), (-1.0, None), (-1.0, None)]
    assert "RLIKE" not in df.select(S.safe_number(F.col("x")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    ports = spark.createDataFrame([(k, t) for k, t in enumerate(["８０", " 443 ", "80d", "65536", "0", "22.0", None])], "k int, t string")
    assert [r.p for r in ports.select("k", S.valid_port(F.col("t")).alias("p")).orderBy("k").collect()] == [80, 443, None, None, None, 22, None]
