"""Exact ranks, running sums, and the metrics and splits on them; per-key tops; dates by vote."""

import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringdata.operators import edges as G
from ringdata.operators import learn as M
from ringdata.operators import reports as R
from ringdata.operators.order import medians, quantile, running_sums, values_at_ranks
from ringdata.operators.times import parse_event_times


def test_quantile_of_a_million_rows_with_ties(spark):
    rows = spark.range(1_000_000).select(((F.pmod(F.xxhash64("id"), F.lit(1000)) - 500) * F.lit(7_000_000_000_000)).alias("v"))
    values = np.array([r.v for r in rows.collect()])
    con = duckdb.connect()
    con.register("t", __import__("pandas").DataFrame({"v": values}))
    for q in (0.0, 0.001, 0.5, 0.8, 1.0):
        assert quantile(rows, F.col("v"), q).first().q == con.execute(f"SELECT quantile_disc(v, {q}) FROM t").fetchone()[0]


def test_quantile_edges(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert quantile(one(), F.col("v"), 0.5).collect()[0].q is None
    assert quantile(one(None, -(2**63), None, 2**63 - 1), F.col("v"), 0.5).first().q == -(2**63)
    assert quantile(one(5), F.col("v"), 0.8).first().q == 5


def test_medians_by_key_and_weight(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(-10**6, 10**6), rng.randint(1, 5)) for _ in range(300)] + [(None, 4, 1)]
    got = {r.k: (r.low, r.high) for r in medians(spark.createDataFrame(rows, "k string, v long, n long"), ["k"], "v", "n").collect()}
    for k in ("a", "b", "c", None):
        flat = [v for key, v, n in rows if key == k for _ in range(n)]
        assert got[k] == (statistics.median_low(flat), statistics.median_high(flat))
    ranks = spark.createDataFrame([("a", r) for r in range(1, 20)], "k string, rank long")
    flat = sorted(v for key, v, n in rows if key == "a" for _ in range(n))
    found = values_at_ranks(spark.createDataFrame(rows, "k string, value long, n long"), ranks, ["k"]).collect()
    assert {r["rank"]: r.value for r in found} == {r: flat[r - 1] for r in range(1, 20)}


def test_running_sums(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 7).alias("w"))
    got = sorted((r.id, r.before_w) for r in running_sums(rows, [F.col("id").desc()], ["w"]).collect())
    total, want = 0, []
    for i in reversed(range(10_000)):
        want.append((i, total))
        total += i % 7
    assert got == sorted(want)


def test_auc_keeps_scores_apart_that_differ_by_1e_12(spark):
    rows = [(1, 0.5 + 1e-12), (0, 0.5), (1, 0.5 - 1e-12), (0, 0.5 - 2e-12), (1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "label int, p double")
    assert M.roc_auc(df).first().auc == 0.75
    assert M.average_precision(df).first().average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert M.roc_auc(df.where("label = 1")).first().auc is None
    assert M.roc_auc(df.where("label > 1")).first().auc is None


def test_auc_of_many_scores(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), round(rng.random(), rng.choice([1, 3, 15]))) for _ in range(3_000)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert M.roc_auc(spark.createDataFrame(rows, "label int, p double")).first().auc == pytest.approx(want, abs=1e-12)


def test_tops_of_a_hot_key_are_cut_before_the_shuffle(spark):
    """Half of all rows in one key: every task sends its best k of a key, no more."""
    rows = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    first = G.first_per_key(rows, ["key"], [F.col("v").desc()])
    tops = R.top_values(rows.withColumn("v", F.col("v").cast("string")), "key", "v", 3)
    for df in (first, tops):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert first.where("key = 'hot'").first().v == 199_998
    assert [r.value for r in tops.where("key = 'hot'").orderBy("rank").collect()] == ["0", "10", "100"]


def test_dates_by_vote(spark):
    rows = [("a", "2024-03-05 10:00:00"), ("a", "2024/03/06"), ("a", "2024-1-7"), ("a", "03/04/2024 10:00:00"), ("a", "25/12/2024"), ("a", ""),
            ("b", "03/04/2024 10:00:00"), ("b", "2024-03-05"), ("b", None), ("c", " "), (None, "04/05/2024"), (None, "2024-01-02"), (None, "2024-01-03")]
    df = spark.createDataFrame(rows, "source string, raw string")
    got = {(r.source, r.raw): (str(r.event.instant), r.event.status) for r in parse_event_times(df, "raw", source=["source"], default_zone="UTC").collect()}
    assert got["a", "03/04/2024 10:00:00"] == ("2024-03-04 10:00:00", "assumed")
    assert got["b", "03/04/2024 10:00:00"] == ("2024-04-03 10:00:00", "assumed")
    assert got["a", "25/12/2024"] == ("2024-12-25 00:00:00", "assumed")
    assert got[None, "04/05/2024"] == ("2024-04-05 00:00:00", "assumed")
    assert got["c", " "] == ("None", "missing") and got["b", None] == ("None", "missing") and len(got) == len(rows)
    all_one = parse_event_times(df, "raw", default_zone="UTC", into="t").where("raw = '04/05/2024'").first()
    assert str(all_one.t.instant) == "2024-04-05 00:00:00"  # six of eleven start with the year
    assert parse_event_times(df.limit(0), "raw").collect() == []
