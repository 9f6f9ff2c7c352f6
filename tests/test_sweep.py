"""The sweep join against all pairs, and with a person who holds most rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ringdata.operators.edges import temporal_coincidences
from ringdata.operators.sweep import near_marks

MARKS, POINTS = "key string, at long", "key string, at long, id int, note string"


def brute(points, marks, width):
    return sorted(((*p, p[0] is not None and p[1] is not None and any(m[0] == p[0] and m[1] is not None and abs(m[1] - p[1]) <= width for m in marks)) for p in points), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    points = [(rng.choice("abcd"), rng.randint(-50, 400), k, "x") for k in range(200)] + [(None, 5, 900, "n"), ("a", None, 901, None), ("a", 7, 902, None), ("a", 7, 902, None)]
    marks = [(rng.choice("abce"), rng.randint(0, 300)) for _ in range(40)] + [("b", 20)] * 30 + [(None, 5), ("a", None)]
    p, m = spark.createDataFrame(points, POINTS), spark.createDataFrame(marks, MARKS)
    for width in (0, 3):
        got = near_marks(p, m, "key", "at", width, order=("id",))
        assert got.columns == ["key", "at", "id", "note", "near"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(points, marks, width)


def test_carry_over_tasks_without_marks(spark):
    """One mark decides points of many later tasks."""
    points, marks = [("a", k, k, "") for k in range(2_000)], [("a", -5)]
    p, m = spark.createDataFrame(points, POINTS), spark.createDataFrame(marks, MARKS)
    got = near_marks(p, m, "key", "at", 1_500, order=("id",)).where("near").agg(F.count(F.lit(1)), F.max("at")).first()
    assert tuple(got) == (1_496, 1_495)


def test_empty(spark):
    p, m = spark.createDataFrame([], POINTS), spark.createDataFrame([], MARKS)
    assert near_marks(p, m, "key", "at", 5).collect() == []
    some = spark.createDataFrame([("a", 1, 1, "")], POINTS)
    assert [r.near for r in near_marks(some, m, "key", "at", 5).collect()] == [False]


def test_one_person_with_most_rows_in_one_slot(spark):
    """200,000 sessions of one person within a second, and 100,000 calls of the same: their pairs would be 2e10."""
    sessions = spark.range(200_000).select(F.lit("hot").alias("subscriber"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 1_000_000).alias("ts"))
    sessions = sessions.unionByName(spark.range(1_000).select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("subscriber"), F.timestamp_micros(F.lit(1_700_000_000_000_000)).alias("ts")))
    calls = spark.range(100_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("caller"), F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("receiver"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("ts"))
    began = time.time()
    got = {r.hi: r.coincidences for r in temporal_coincidences(calls, sessions, 300).collect()}
    assert got == {f"p{k}": 1_000 for k in range(50)}
    assert time.time() - began < 60
    points = calls.select(F.col("caller").alias("key"), F.unix_micros("ts").alias("at"), "event_id")
    marks = sessions.select(F.col("subscriber").alias("key"), F.unix_micros("ts").alias("at"))
    spread = near_marks(points, marks, "key", "at", 1, order=("event_id",)).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 80_000


def test_ends_of_the_interval_and_cap(spark):
    t = datetime(2024, 1, 1, 12)
    s = timedelta(seconds=300)
    sessions = spark.createDataFrame([("a", t), ("b", t + s), ("c", t + s + timedelta(microseconds=1)), (None, t)], "subscriber string, ts timestamp")
    calls = spark.createDataFrame([(1, "a", "b", t), (2, "b", "a", t), (3, "a", "c", t), (4, "a", None, t), (5, "a", "b", None), (1, "a", "b", t)], "event_id long, caller string, receiver string, ts timestamp")
    assert [tuple(r) for r in temporal_coincidences(calls, sessions, 300).collect()] == [("a", "b", 2)]
    assert [tuple(r) for r in temporal_coincidences(calls, sessions, 300, cap=1).collect()] == [("a", "b", 1)]
