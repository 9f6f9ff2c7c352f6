"""Sets as rows: intersections against Python's, parts, and a person with a million contacts."""

import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from ringdata.operators import profiles as A
from ringdata.operators.sets import set_parts, shared_members

MILLION = 1_000_000


def test_shared_members(spark):
    rng = random.Random(3)
    sets = {(p, k): {str(rng.randint(0, 30)) for _ in range(rng.choice([0, 1, 5, 25]))} for p in "abcdefg" for k in ("x", "y")}
    rows = [(p, k, m) for (p, k), s in sets.items() for m in s]
    members = spark.createDataFrame(rows, "person string, kind string, member string")
    pairs = [*combinations("abcdefg", 2), ("a", "b"), ("a", "nobody"), ("c", "c")]
    got = shared_members(spark.createDataFrame(pairs, "lo string, hi string"), members).collect()
    want = {(a, b, k): (len(sets[a, k]), len(sets[b, k]), len(sets[a, k] & sets[b, k])) for a, b in set(pairs) if b != "nobody" for k in ("x", "y") if sets[a, k] and sets[b, k]}
    assert {(r.lo, r.hi, r.kind): (r.size_lo, r.size_hi, r.shared) for r in got} == want and len(got) == len(want)


def test_parts_hold_every_member_once(spark):
    rows = [("a", str(k)) for k in range(1_000)] + [("b", "1"), ("b", "1"), ("b", "2"), (None, "9")]
    got = set_parts(spark.createDataFrame(rows, "key string, m string"), "key", "m", "ms", part=100).collect()
    mine = [r for r in got if r.key == "a"]
    assert len(mine) == 10 and sorted(x for r in mine for x in r.ms) == sorted(str(k) for k in range(1_000))
    assert max(len(r.ms) for r in mine) < 150 and all(r.ms == sorted(r.ms) for r in mine)
    assert sorted((r.key or "", r.part, r.ms) for r in got if r.key != "a") == [("", 0, ["9"]), ("b", 0, ["1", "2"])]


def calls_of_a_hub(spark):
    """A hub that called a million people, each twice; p0 to p99 also called q0 to q9."""
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 86_400)
    common = [F.lit(60.0).alias("duration"), F.lit("VOICE").alias("event_type"), t.alias("ts")]
    hub = spark.range(2 * MILLION).select(F.lit("hub").alias("caller"), F.concat(F.lit("p"), (F.col("id") % MILLION).cast("string")).alias("receiver"), *common)
    others = spark.range(1_000).select(F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("caller"), F.concat(F.lit("q"), F.floor(F.col("id") / 100).cast("string")).alias("receiver"), *common)
    return hub.unionByName(others)


def test_features_of_a_person_with_a_million_contacts(spark):
    calls = calls_of_a_hub(spark)
    sessions = spark.createDataFrame([], "subscriber string, ts timestamp, destination string, port string, cell string, mb double, session_s double")
    pairs = spark.createDataFrame([(min("hub", p), max("hub", p)) for p in [f"p{k}" for k in range(200)]] + [("p1", "p2"), ("p1", "p500")], "lo string, hi string")
    began = time.time()
    got = {(r.lo, r.hi): r for r in A.pair_features(pairs, calls, sessions).collect()}
    assert time.time() - began < 120 and len(got) == 202
    assert (got["hub", "p1"].cdr_degree_max, got["hub", "p1"].cdr_degree_min, got["hub", "p1"].cdr_common_contacts, got["hub", "p1"].cdr_events_total) == (MILLION, 11.0, 0.0, 2.0)
    assert (got["hub", "p150"].cdr_degree_min, got["hub", "p150"].cdr_contact_jaccard) == (1.0, 0.0)
    assert (got["p1", "p2"].cdr_common_contacts, got["p1", "p2"].cdr_contact_jaccard) == (11.0, 1.0)
    assert (got["p1", "p500"].cdr_common_contacts, round(got["p1", "p500"].cdr_contact_jaccard, 9)) == (1.0, round(1 / 11, 9))


def test_contacts_of_a_person_with_a_million(spark):
    calls = calls_of_a_hub(spark)
    stats = A.call_person_stats(calls).where("person = 'hub'").first()
    assert (stats.events, stats.contacts) == (2 * MILLION, MILLION)
    parts = A.contact_sets(calls).where("person = 'hub'").select(F.size("contacts").alias("n")).collect()
    assert len(parts) == 16 and sum(r.n for r in parts) == MILLION and max(r.n for r in parts) < 70_000


def test_sets_of_any_size_meet(spark, monkeypatch):
    """Carried sets, looked-up ones, and pairs of one of each; the plan of small sets looks up no member by pair."""
    from ringdata.operators import sets as T

    rows = [(p, "x", str(m)) for p, n in (("a", 3), ("b", 9), ("c", 12), ("d", 4)) for m in range(n)]
    members = spark.createDataFrame(rows, "person string, kind string, member string")
    pairs = spark.createDataFrame([*combinations("abcd", 2)], "lo string, hi string")
    one = sorted(map(tuple, shared_members(pairs, members).collect()))
    assert one == [(a, b, "x", n[a], n[b], min(n[a], n[b])) for n in [dict(a=3, b=9, c=12, d=4)] for a, b in combinations("abcd", 2)]
    for small in (0, 4, 9):
        monkeypatch.setattr(T, "SMALL", small)
        assert sorted(map(tuple, shared_members(pairs, members).collect())) == one


def test_features_by_rows_and_by_arrays_are_alike(spark, monkeypatch):
    """Small and large people, events cut down to the people asked for or not; a plan without large people looks up no member and groups no pair's kinds."""
    from ringdata.sources import views as V

    d = "/root/testdata/sf0.001"
    calls = V.calls(spark, d).withColumn("receiver", F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(F.col("receiver")))
    sessions = V.sessions(spark, d).withColumn("port", F.when(F.col("event_id") % 9 == 0, " NaN ").otherwise(F.col("port"))).where("subscriber <> '3'")
    pairs = V.pairs(spark, d).select("lo", "hi").where("lo <> '4'").unionByName(spark.createDataFrame([("1", "nobody"), ("1", "3")], "lo string, hi string"))
    shown = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in A.pair_features(pairs, calls, sessions).collect())
    one = shown()
    assert "Generate" not in A.pair_features(pairs, calls, sessions)._jdf.queryExecution().optimizedPlan().toString()
    sets = {}
    for r in A.person_members(calls, sessions).collect():
        sets.setdefault((r.person, r.kind), set()).add(r.member)
    names = {"contacts": "cdr_contact_jaccard", "destinations": "ipdr_destination_jaccard", "ports": "ipdr_port_jaccard", "cells": "ipdr_cell_jaccard", "buckets": "ipdr_time_bucket_jaccard"}
    for row in one:
        for kind, name in names.items():
            a, b = (sets.get((p, kind), set()) for p in row[:2])
            assert row[2 + A.FEATURES.index(name)] == round(len(a & b) / len(a | b), 9) if a | b else row[2 + A.FEATURES.index(name)] == 0
    for small, people in ((0, 0), (5, 1_000), (66, 0), (66, 1_000)):
        monkeypatch.setattr(A, "SMALL", small)
        monkeypatch.setattr(A, "CUT_PEOPLE", people)
        assert shown() == one


def test_days_need_no_row_of_each_and_contacts_no_pass(spark):
    """Days of a pair over many blocks, before 1970 and missing; no shuffle by day. Contacts by the pairs' numbers are those of the calls."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["a", "b", "c", None]), rng.choice([None, 86_400 * rng.randint(-300, 300) + rng.randint(0, 86_399)])) for _ in range(600)]
    rows += [("d", "e", None), ("e", "d", None)]
    calls = spark.createDataFrame(rows, "caller string, receiver string, t long").select("caller", "receiver", F.timestamp_seconds("t").alias("ts"), F.lit(2.0).alias("duration"), F.lit("").alias("event_type"))
    days, ends = {}, {}
    for a, b, t in rows:
        key = (min(x for x in (a, b) if x), max(x for x in (a, b) if x)) if a or b else (None, None)
        days.setdefault(key, set()).update([] if t is None else [t // 86_400])
        for p, c in ((a, b), (b, a)):
            if p:
                ends[p, c] = ends.get((p, c), 0) + 1
    stats = A.call_pair_stats(calls)
    assert {(r.lo, r.hi): r.days for r in stats.collect()} == {k: len(v) for k, v in days.items()}
    plan = A.call_pair_stats(calls)._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and plan.count("Exchange") == 2
    got = {(r.person, r.contact): r.n for r in A._met(A._pair_stats(calls)).collect() if r.person}
    assert got == ends


def test_sets_hold_numbers_of_one_byte_or_two(spark, monkeypatch):
    """Numbered kinds and hashed ones give the same features; spellings of one member have one number, missing ones none."""
    from ringdata.sources import views as V

    d = "/root/testdata/sf0.001"
    port = F.when(F.col("event_id") % 9 == 0, " NaN ").when(F.col("event_id") % 9 == 1, F.concat(F.lit(" "), "port")).otherwise(F.col("port"))
    sessions = V.sessions(spark, d).withColumn("port", port).withColumn("cell", F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("C"), F.col("event_id").cast("string"))))
    calls, pairs = V.calls(spark, d), V.pairs(spark, d).select("lo", "hi")
    shown = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in A.pair_features(pairs, calls, sessions).collect())
    one = shown()
    coded = A._coded(sessions.withColumnRenamed("subscriber", "person"))
    types = {k: coded.schema[f"{k}_code"].dataType.simpleString() for k in ("destinations", "ports", "cells", "buckets")}
    assert types == {"destinations": "tinyint", "ports": "tinyint", "cells": "smallint", "buckets": "smallint"}
    seen = coded.select(A.member(F.col("port")).alias("m"), F.col("ports_code").alias("c")).distinct().collect()
    assert len({r.m for r in seen}) == len({r.c for r in seen}) == len(seen) and all((r.m is None) == (r.c is None) for r in seen)
    for most in (0, 150):
        monkeypatch.setattr(A, "CODES", most)
        assert shown() == one


def test_split_shuffles_only_the_blocks_where_a_split_ends(spark):
    from ringdata.operators import learn as M

    df = spark.range(30_000).selectExpr("concat('p', id) AS lo", "cast(id % 3 = 0 AS int) AS label", "id * 1.0 AS x")
    s = M.stratified_split(df, ["lo"]).withColumn("u", F.xxhash64(F.lit(42), "lo"))
    rows = s.collect()
    assert s.columns == ["label", "lo", "x", "split", "u"] and len({r.lo for r in rows}) == 30_000
    for y, n in ((0, 20_000), (1, 10_000)):
        own = sorted((r for r in rows if r.label == y), key=lambda r: ((r.u % 2**64) >> 56, r.u))
        assert [r.split for r in own] == ["test"] * (n // 5) + ["validation"] * (n // 5) + ["train"] * (3 * n // 5)
    # the rows of whole blocks pass by the window
    assert s._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
