"""Facts that the operators must keep, and invariants of those without SQL."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.operators import correlate as K
from ringdata.operators import evidence as E
from ringdata.operators import filters as P
from ringdata.operators import graph as G
from ringdata.operators import identity as J
from ringdata.operators import learn as M
from ringdata.operators import profiles as A
from ringdata.operators import sampling as R
from ringdata.operators.schema import canonicalize_source, resolve_schema
from ringdata.sources import files
from ringdata.sources import views as V


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_phone_spellings(spark):
    phone = lambda c: S.normalize_identifier(c, phone=True)
    assert one(spark, phone, "+91 (98765) 43210", '="9876543210"', "9876543210", "09876543210", "0091 98765 43210", "9876543210.00") == ["919876543210"] * 6
    assert one(spark, S.normalize_identifier, "1234567890", " NaN ", None, "<NA>", "Ab  C") == ["1234567890", "", "", "", "ab c"]
    assert one(spark, lambda c: S.clean_text(c), "ＡＢ​", '="a""b"') == ["AB", 'a"b']


def test_times(spark):
    rows = [("2026-06-01", ""), ("01/06/2026 10:00:00", ""), ("2026-06-01T10:05:00+05:30", ""), ("05/13/2026", ""), ("2026-03-29 02:30:00", "Europe/Berlin"), ("2026-10-25 02:30:00", "Europe/Berlin"), ("2026-06-01 10:00", "Mars/Olympus"), ("2026-06-01 10:00", "gmt+2"), ("01-06-2026", ""), ("x", ""), (None, ""), ("2026/06/01 09:00:00.5", "UTC")]
    parsed = spark.createDataFrame(rows, "t string, z string").select(S.parse_event_time(F.col("t"), F.col("z")).alias("e"))
    got = [(r[0], r[1]) for r in parsed.select(S.iso_utc(F.col("e.instant")), "e.status").collect()]
    assert got == [
        ("2026-05-31T18:30:00Z", "assumed"), ("2026-06-01T04:30:00Z", "assumed"), ("2026-06-01T04:35:00Z", "explicit"), ("2026-05-12T18:30:00Z", "assumed"), (None, "invalid"), (None, "invalid"), (None, "invalid_zone"),
        ("2026-06-01T08:00:00Z", "zone"), ("2026-05-31T18:30:00Z", "assumed"), (None, "invalid"), (None, "missing"), ("2026-06-01T09:00:00Z", "zone"),
    ]


def test_ambiguous_alias_is_quarantined(spark):
    amap = J.finalize_map(spark.createDataFrame([("x", "a"), ("x", "b"), ("ipdr-1", "cdr-1")], "alias string, canonical string"))
    df = spark.createDataFrame([("X",), ("IPDR-1",), ("new",), (None,)], "id string")
    got = [tuple(r)[1:] for r in J.canonicalize_ids(df, "id", False, amap).collect()]
    assert got == [("", "ambiguous_mapping"), ("cdr-1", "explicit_mapping"), ("new", "normalized_identifier"), ("", "missing")]
    got = [r.canonical for r in J.canonicalize_ids(df, "id", False, amap, policy="drop_ambiguous").collect()]
    assert got == ["x", "cdr-1", "new", ""]


def test_json_maps(spark, tmp_path):
    want = {("ipdr-1", "cdr-1"), ("cdr-1", "cdr-1")}
    for k, j in enumerate([{"IPDR-1": "CDR-1"}, {"CDR-1": ["IPDR-1"]}, {"CDR-1": {"canonical": "CDR-1", "aliases": ["IPDR-1"]}}, [{"alias": "IPDR-1", "canonical": "CDR-1"}]]):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(j, indent=1))
        got = {(r.alias, r.canonical) for r in J.alias_map_from_json(spark, str(path)).collect()}
        assert ("ipdr-1", "cdr-1") in got and got <= want


def decide(spark, n, p, m, answer, mode=None, ambiguous=0):
    ev = spark.createDataFrame([(True, True, n, p, m, ambiguous)], "cdr_present boolean, ipdr_present boolean, cdr_count int, ipdr_count int, matched int, ambiguous int")
    return E.identity_decision(ev, F.lit(answer), F.lit(mode)).first()


def test_decisions(spark):
    assert not decide(spark, 1, 1, 0, "same person").allowed
    assert decide(spark, 1, 1, 1, "Same_Person").allowed and not decide(spark, 1, 1, 1, "same", ambiguous=1).allowed
    r = decide(spark, 2, 2, 1, "multiple-person dataset")
    assert r.allowed and "partial" in r.warnings and r["mode"] == "multi_person_conditioned"
    assert decide(spark, 1, 1, 1, None).status == "awaiting_identity_answer" and not decide(spark, 0, 1, 0, "different").allowed
    assert not decide(spark, 2, 2, 2, "not sure", "combined").allowed


def test_one_subscriber_gives_no_pairs(spark):
    s = spark.createDataFrame([("a", "2026-06-01 10:00:00", "d", "443")], "subscriber string, ts string, destination string, port string").withColumn("ts", F.col("ts").cast("timestamp"))
    for mode in ("exhaustive", "items"):
        out = K.correlate_sessions(s, mode)
        assert out.count() == 0 and len(out.columns) == 7
    people = spark.range(5_000).selectExpr("cast(id AS string) AS person")
    assert K.all_pairs(people).agg(F.count("*"), F.count_if(F.col("lo") < F.col("hi"))).first()[:] == (12_497_500, 12_497_500)


def test_items_are_those_of_the_profiles(spark):
    """Case, blanks and words for missing values: the same members in sets and in shared items."""
    rows = [("a", "Host ", "443"), ("a", "host", "nan"), ("b", "host", "443"), ("b", " NONE", "null"), ("b", "", " 443")]
    s = spark.createDataFrame([(p, "2026-06-01 10:00:00", d, q) for p, d, q in rows], "subscriber string, ts string, destination string, port string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = K.correlate_sessions(s).first()
    assert (r.score, r.shared_destination, r.shared_port, r.shared_bucket) == (1.0, 1, 1, 1)


def test_items_that_everyone_holds(spark, monkeypatch):
    """Blocks and the plain join give the same sums; 400 people share one destination."""
    n = 400
    s = spark.range(n).selectExpr("cast(id AS string) AS subscriber", "timestamp_seconds(1780000000 + id % 7 * 3600) AS ts", "if(id % 2 = 0, 'all', 'All ') AS destination", "cast(id % 90 AS string) AS port")
    one = {(r.lo, r.hi): r[2:6] for r in K.correlate_sessions(s, "items").collect()}
    assert len(one) == n * (n - 1) // 2
    monkeypatch.setattr(K, "HOT_ITEM", 10**6)
    assert {(r.lo, r.hi): r[2:6] for r in K.correlate_sessions(s, "items").collect()} == one
    monkeypatch.setattr(K, "HOT_ITEM", 2)
    monkeypatch.setattr(K, "BLOCK", 30)
    monkeypatch.setattr(K, "ITEMS_AT_ONCE", 5)
    assert {(r.lo, r.hi): r[2:6] for r in K.correlate_sessions(s, "items").collect()} == one


def test_durations_below_zero_count_as_zero(spark):
    from ringdata.operators import profiles as A

    t = "2026-06-01 10:00:00"
    calls = spark.createDataFrame([("a", "b", t, x, "") for x in (-5.0, 7.0, None)], "caller string, receiver string, ts string, duration double, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = A.call_pair_stats(calls).first()
    assert (r.dur, r.dur2, r.dur_max) == (7.0, 49.0, 7.0)
    sessions = spark.createDataFrame([("a", t, "d", "1", "c", x, x) for x in (-5.0, 7.0, None)], "subscriber string, ts string, destination string, port string, cell string, session_s double, mb double").withColumn("ts", F.col("ts").cast("timestamp"))
    r = A.session_person_stats(sessions).first()
    assert (r.sessions, r.seconds, r.mb) == (3, 7.0, 7.0)


def test_identifiers_in_other_characters(spark):
    from ringdata.functions import scalars as S
    from ringdata.operators import identity as J

    df = spark.createDataFrame([("９８７６５４３２１０",), ("\tNaN\n",), ("\u3000=\"００１２\"\u00a0",), ("Ａb\u2003c",), ("x\u200by",)], "raw string")
    assert [r[0] for r in df.select(S.normalize_identifier(F.col("raw"), True)).collect()] == ["919876543210", "", "0012", "ab c", "xy"]
    wide = spark.createDataFrame([("", "9876543210", "I1"), ("s2", "9876543211", None)], "subscriber_id string, msisdn string, imei string")
    got = {r.alias: r.canonical for r in J.alias_map_from_table(wide).collect()}
    assert got == {"919876543210": "919876543210", "i1": "919876543210", "s2": "s2", "919876543211": "s2"}
    table = spark.createDataFrame([("src1", "9876543210")], "source_identifier string, Mobile_No string")
    assert {r.canonical for r in J.subscriber_aliases(table).collect()} == {"919876543210"}


def test_item_mode_equals_exhaustive_on_its_pairs(spark):
    from ringdata.sources import views as V

    s = V.sessions(spark, "/root/testdata/sf0.001")
    a, b = (K.correlate_sessions(s, m) for m in ("exhaustive", "items"))
    assert b.exceptAll(a).count() == 0 and a.where("shared_destination + shared_port + shared_bucket > 0").exceptAll(b).count() == 0


def test_pair_features_by_hand(spark):
    calls = spark.createDataFrame([("a", "b", "2026-06-01 23:00:00", 10.0, "VOICE"), ("b", "a", "2026-06-03 12:00:00", 30.0, "SMS"), ("a", "c", "2026-06-03 12:00:00", 5.0, "")], "caller string, receiver string, ts string, duration double, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = spark.createDataFrame([], "subscriber string, ts timestamp, destination string, port string, cell string, session_s double, mb double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "lo string, hi string")
    f = {r.lo: r for r in A.pair_features(pairs, calls, sessions).collect()}
    r = f["a"]
    assert len(A.FEATURES) == 39 and r.cdr_events_total == 2 and r.cdr_reciprocity_ratio == 1.0 and r.cdr_mean_duration_seconds == 20 and r.cdr_duration_std_seconds == 10
    assert r.cdr_active_days == 2 and abs(r.cdr_activity_span_days - 37 / 24) < 1e-9 and r.cdr_night_ratio == 0.5 and r.cdr_voice_ratio == 0.5 and r.cdr_contact_share_min == 2 / 3 and r.cdr_common_contacts == 0
    assert f["b"].cdr_has_direct_interaction == 0 and f["b"].cdr_common_contacts == 1 and f["b"].cdr_contact_jaccard == 1 and f["b"].ipdr_both_people_present == 0


def test_csv_with_preamble(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿Report,,\nfrom,to,\nMobile_No,Other_Party_No,Call_Date\n"=""98""",NaN,01/06/2026\n5,"a,b",\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_records(spark, str(tmp_path / "x.csv")).collect()]
    assert sorted(got) == [("5", "a,b", ""), ('="98"', "NaN", "01/06/2026")]
    assert resolve_schema(["mobile no", "OTHER_PARTY_NO"], "cdr") == {"caller": "mobile no", "receiver": "OTHER_PARTY_NO"}
    with pytest.raises(ValueError):
        resolve_schema(["x"], "cdr")
    df = spark.createDataFrame([("1", "01/06/2026", "10:00:00")], "Mobile_No string, Call_Date string, call_time string")
    assert canonicalize_source(df, "cdr").first().when == "01/06/2026 10:00:00"


def test_malformed_rows_fail(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n1,2,3\n4\n")
    df = spark.read.csv(str(tmp_path / "m.csv"), schema="a string, b string, _corrupt_record string", columnNameOfCorruptRecord="_corrupt_record")
    with pytest.raises(Exception, match="malformed row"):
        files.fail_on_malformed(df).collect()


def test_junk_strictness(spark):
    df = spark.createDataFrame([("1", "ok"), ("1a", "ok"), ("2", "OTP here")], "n string, t string")
    assert P.filter_junk(df, ["n", "absent"]).count() == 1
    with pytest.raises(ValueError):
        P.filter_junk(df, ["absent"], strict=True)


def test_plans_keep_every_source(spark):
    src = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "person string, calls long")
    plan = R.plan_profiles(src, 100).collect()
    assert len(plan) == 100 and {"a", "b", "c"} <= {r.agent_id for r in plan} and len({r.source_id for r in plan}) == 3
    with pytest.raises(ValueError):
        R.plan_profiles(src.limit(1), 5)


def test_resampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"p{i % 5}", str(i % 7)) for i in range(200)], "person string, hour string")
    plan = R.plan_profiles(df.groupBy("person").agg(F.count(F.lit(1)).alias("calls")), 8)
    draw = lambda k: sorted(tuple(r) for r in R.resample_events(plan.repartition(k), {"hour": (df.repartition(k), "person", "hour")}, 6).select("agent", "i", "hour", "ts").collect())
    assert draw(1) == draw(5) and len(draw(1)) == 48


def test_pairs_are_unranked_exactly(spark):
    x, y = R._unrank(F.col("id"))
    got = [(r[0], r[1]) for r in spark.range(190).select(x, y).collect()]
    assert got == [(a, b) for b in range(20) for a in range(b)]


def test_non_edges_of_dense_graphs(spark):
    names = [f"n{i:02d}" for i in range(40)]
    free = {p for i, p in enumerate(itertools.combinations(names, 2)) if i % 97 == 0}
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame([p for p in itertools.combinations(names, 2) if p not in free], "lo string, hi string")
    draw = lambda n, e: [tuple(r) for r in R.sample_non_edges(nodes, e, n).collect()]
    assert sorted(draw(100, edges)) == sorted(free)
    some = draw(5, edges)
    assert len(set(some)) == 5 and set(some) <= free
    turned = edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))
    assert sorted(draw(100, turned)) == sorted(free)
    assert len({x for p in draw(60, edges.limit(0)) for x in p}) > 30  # spread over the nodes


def test_graph_against_brute_force(spark):
    cliques = [list("abcde"), list("fghij")]
    edges = [p for c in cliques for p in itertools.combinations(c, 2)] + [("e", "f")]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in edges], "lo string, hi string, p double")
    labels = {r.node: r.community for r in G.communities(df).collect()}
    assert {labels[n] for n in "abcde"} == {"a"} and {labels[n] for n in "ghij"} == {labels["g"]} != {"a"}
    nodes = sorted({n for e in edges for n in e})
    v = {n: 1.0 for n in nodes}
    for _ in range(200):
        v = {n: v[n] + sum(v[b if a == n else a] for a, b in edges if n in (a, b)) for n in nodes}
        norm = sum(x * x for x in v.values()) ** 0.5
        v = {n: x / norm for n, x in v.items()}
    got = {r.node: r.centrality for r in G.eigenvector_centrality(df).collect()}
    assert all(abs(got[n] - v[n]) < 1e-3 for n in nodes)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5)], "label int, p double")
    r = M.binary_metrics(df, threshold=0.9).first()
    assert r.precision == 0 and r.specificity == 0 and M.roc_auc(df).first()[0] is None
    assert M.threshold_table(df).count() == 181


def test_trained_model_keeps_its_word(spark, tmp_path):
    rows = [(f"p{i}", f"q{i}", i % 2, float(i % 2 * 5 + (i * 7 % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "lo string, hi string, label int, cdr_events_total double").withColumn("cdr_common_contacts", F.col("cdr_events_total") / 2)
    columns = ["cdr_events_total", "cdr_common_contacts"]
    s = M.stratified_split(df, ["lo"])
    counts = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert counts == {(y, k): n for y in (0, 1) for k, n in (("test", 6), ("validation", 6), ("train", 18))}
    parts = {k: s.where(F.col("split") == k).drop("split") for k in ("train", "validation", "test")}
    model = M.train_classifier(parts["train"], parts["validation"], columns)
    assert M.evaluate(model, {"test": parts["test"]}).first().auc == 1.0
    model.save(str(tmp_path))
    a, b = (m.score(parts["test"]).orderBy("lo").select("p").collect() for m in (model, M.PairModel.load(spark, str(tmp_path))))
    assert all(abs(x.p - y.p) < 1e-6 for x, y in zip(a, b))
    with pytest.raises(ValueError):
        model.score(df.drop("cdr_common_contacts"))


def test_agent_lines_keep_every_item(spark):
    from ringdata.operators import reports as R

    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)"
    calls = spark.range(400).selectExpr("'a' AS caller", "concat('b', id % 3) AS receiver", f"{at} AS ts", "1.0D AS duration", "'VOICE' AS event_type")
    sessions = spark.range(120).selectExpr("'a' AS subscriber", f"{at} AS ts", "'x' AS destination", "'443' AS port", "1.0D AS mb")
    edges = spark.createDataFrame([("a", "b1", 0.2), ("a", "b2", None), ("a", "c", 0.9)], "lo string, hi string, score double")
    points = spark.createDataFrame([("a", 20.0, 70.0, "T2", 4), ("a", 21.0, 70.0, "T1", 4), ("a", 22.0, 70.0, "T0", 9)], "agent string, lat double, lng double, tower string, n long").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS last_ts")
    agents = spark.createDataFrame([("a",), ("b0",), ("nobody",)], "agent string")
    lines = R.agent_lines(calls, sessions, edges, points, agents).orderBy("agent", "part", "k").collect()
    of = lambda agent, part: [r for r in lines if (r.agent, r.part) == (agent, part)]
    for part, n in (("calls", 400), ("sessions", 120), ("contacts", 3), ("friends", 3), ("locations", 3)):
        assert [r.k for r in of("a", part)] == list(range(1, n + 1))
    assert [r.ts for r in of("a", "calls")] == sorted((r.ts for r in of("a", "calls")), reverse=True)
    assert [(r.name, r.known_friend) for r in of("a", "contacts")] == [("b0", False), ("b1", True), ("b2", True)]
    assert [r.name for r in of("a", "friends")] == ["c", "b1", "b2"]
    assert [r.name for r in of("a", "locations")] == ["T0", "T1", "T2"]
    assert len(of("b0", "calls")) == 134 and {r.agent for r in lines} == {"a", "b0"}


def test_content_fingerprint(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string")
    rows = [("x", None), ("", "y"), (None, None), ("1:x", "y")]
    one = E.content_fingerprint(make(rows)).first()
    assert one == E.content_fingerprint(make(rows[::-1])).first() and one.rows == 4
    assert one.digest != E.content_fingerprint(make([("x", ""), *rows[1:]])).first().digest
    assert E.content_fingerprint(make([])).first().asDict() == {"rows": 0, "digest": "0"}
    check = lambda **s: E.validation_fingerprint(s, E.content_fingerprint(make(rows))).first().fingerprint
    assert check(zone="UTC", country="91") == check(country="91", zone="UTC") != check(zone="UTC", country="1")


def test_pairs_are_scored_where_blocks_meet(spark, monkeypatch):
    """No join or exchange above the tasks that make pairs; small blocks, strips and batches change nothing."""
    s = V.sessions(spark, "/root/testdata/sf0.001")
    plan = K.correlate_sessions(s)._jdf.queryExecution().sparkPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0]
    assert above != plan and "Join" not in above and "Aggregate" not in above
    one = sorted(map(tuple, K.correlate_sessions(s).collect()))
    four = sorted((r.lo, r.hi, round(r.cosine, 9)) for r in K.weighted_item_cosine(s).collect())
    pairs = sorted(map(tuple, K.all_pairs(s.selectExpr("subscriber AS person")).collect()))
    for name, value in {"BLOCK": 4, "STRIP": 3, "ITEMS_AT_ONCE": 7, "PAIRS_AT_ONCE": 5, "HOT_ITEM": 3, "LIST": 4}.items():
        monkeypatch.setattr(K, name, value)
    assert sorted(map(tuple, K.correlate_sessions(s).collect())) == one and len(one) == len(pairs)
    assert sorted((r.lo, r.hi, round(r.cosine, 9)) for r in K.weighted_item_cosine(s).collect()) == four
    assert sorted(map(tuple, K.all_pairs(s.selectExpr("subscriber AS person")).collect())) == pairs == [r[:2] for r in one]


def test_walk_in_many_tasks(spark, monkeypatch):
    """The same places however they are dealt; the number of tasks follows the number of places."""
    nodes = spark.range(40).select(F.col("id").cast("string").alias("node"))
    numbered = R._numbered(nodes, 7)
    name, pairs = {r["at"]: r.node for r in numbered.collect()}, 780
    step = next(s for s in itertools.count(pairs * R.GOLDEN // 10**9) if R.math.gcd(s, pairs) == 1)
    ends = [(x, y) for y in range(40) for x in range(y)]
    want = [(i, *sorted(name[e] for e in ends[(i * step + 7 * 7919) % pairs])) for i in range(501)]
    monkeypatch.setattr(R, "TASK_PLACES", 50)
    monkeypatch.setattr(R, "ROW_PLACES", 50)
    got = R._pair_walk(numbered, pairs, 501, 7)
    assert sorted(map(tuple, got.collect())) == want
    assert "splits=Some(11)" in got._jdf.queryExecution().optimizedPlan().toString()
    k = 2**61 - 7
    x, y = spark.range(1).select(*R._unrank(F.lit(k))).first()
    assert y * (y - 1) // 2 + x == k and 0 <= x < y


def test_documents_of_long_lists_and_short_ones(spark, monkeypatch, tmp_path):
    """Lists placed by ranges and by agent are alike; no range is sampled where no list is long; each file holds an agent's lines together."""
    from ringdata.operators import reports as R
    from ringdata.plans import q_reports as Q
    from ringdata.sources import files

    d = "/root/testdata/sf0.001"
    one = R.agent_documents(*Q._documents(spark, d))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [agent" in plan and "_first" not in plan
    want = sorted(map(repr, one.collect()))
    monkeypatch.setattr(R, "LIST_ROWS", 60)
    docs, path = R.agent_documents(*Q._documents(spark, d)), str(tmp_path / "docs")
    assert "_first" in docs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, docs.collect())) == want
    files.write_agent_docs(docs, path, dealt=True)
    assert sorted(map(repr, files.read_agent_docs(spark, path, docs.schema).collect())) == want
    held = spark.read.parquet(f"{path}/files").collect()
    assert sum(r.rows for r in held) == len(want)
    for r in held:
        lines = (tmp_path / "docs" / "documents" / r.file).read_text().splitlines()[r.first_row :][: r.rows]
        assert len(lines) == r.rows and all(f'"agent_id":"{r.agent_id}"' in x for x in lines)
