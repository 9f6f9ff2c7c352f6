"""Queries: profiles, pair features, correlation, edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringdata.operators import correlate as K
from ringdata.operators import edges as G
from ringdata.operators import profiles as A
from ringdata.plans.q_basic import DUCK_ISO, iso
from ringdata.plans.registry import query
from ringdata.sources import views as V


def r6(c, name):
    return F.round(c + F.lit(1e-9), 6).alias(name)


def q6(expr, name):
    return f"round(({expr}) + 1e-9, 6) AS {name}"


def draw_sql(seed, *cells):
    """SQL of edges.uniform."""
    return f"(('0x' || substr({hash_sql(seed, *cells)}, 1, 13))::BIGINT / {1 << 52}::DOUBLE)"


def hash_sql(seed, *cells):
    """SQL of edges.rank_hash."""
    return f"md5(concat_ws('|', '{seed}', {', '.join(cells)}))"


HOURS = ", ".join(f"count(*) FILTER (hour(ts) = {h})" for h in range(24))
NIGHT, WEEKEND = "hour(ts) < 6 OR hour(ts) >= 22", "isodow(ts) >= 6"
PROF = f""", prof AS (SELECT subscriber AS person, count(*) AS sessions, sum(mb) AS mb, sum(session_s) AS seconds, count(*) AS timed, count(DISTINCT ts::DATE) AS days, [{HOURS}] AS hours, count(*) FILTER ({NIGHT}) AS night, count(*) FILTER ({WEEKEND}) AS weekend,
 list_distinct(list(destination)) AS dest, list_distinct(list(port)) AS ports, list_distinct(list(cell)) AS cells, list_distinct(list(epoch(date_trunc('hour', ts))::BIGINT)) AS buckets FROM sessions GROUP BY 1),
ends AS (SELECT caller AS person, receiver AS contact FROM calls UNION ALL SELECT receiver, caller FROM calls),
people AS (SELECT person, count(*) AS events, list_distinct(list(contact)) AS contacts FROM ends GROUP BY 1),
stats AS (SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, count(*) FILTER (caller < receiver) AS d0, count(*) FILTER (caller > receiver) AS d1, sum(duration) AS dur, sum(duration * duration) AS dur2, max(duration) AS dur_max,
 count(DISTINCT ts::DATE) AS days, min(ts) AS f, max(ts) AS l, count(*) FILTER ({NIGHT}) AS night, count(*) FILTER ({WEEKEND}) AS weekend, count(*) FILTER (event_type IN ('VOICE', 'data call')) AS voice, count(*) AS n FROM calls GROUP BY ALL)
"""


def jac(a, b):
    return f"CASE WHEN len(list_concat({a}, {b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


def cos(a, b):
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def joined(c):
    return F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), "|").alias(c)


def joined_sql(c, name=None):
    return f"array_to_string(list_sort(list_transform({c}, lambda x: x::VARCHAR)), '|') AS {name or c}"


@query("a7_session_profiles", PROF + f"SELECT person, sessions, {joined_sql('dest', 'destinations')}, {joined_sql('ports')}, {joined_sql('buckets')}, array_to_string(hours, '|') AS hours FROM prof")
def a7(spark, d):
    p = A.session_profiles(V.sessions(spark, d))
    return p.select("person", "sessions", joined("destinations"), joined("ports"), joined("buckets"), F.array_join(F.transform("hours", lambda x: x.cast("string")), "|").alias("hours"))


@query("a8_call_pair_stats", PROF + f"SELECT lo, hi, d0, d1, round(dur, 4) AS dur, dur_max, days, strftime(f, {DUCK_ISO}) AS first_ts, strftime(l, {DUCK_ISO}) AS last_ts, night, weekend, n AS typed, voice FROM stats")
def a8(spark, d):
    s = A.call_pair_stats(V.calls(spark, d))
    return s.select("lo", "hi", "d0", "d1", F.round("dur", 4).alias("dur"), "dur_max", "days", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"), "night", "weekend", "typed", "voice")


@query("a9_call_person_stats", PROF + f"SELECT person, events, len(contacts) AS contacts, 0 AS part, {joined_sql('contacts', 'names')} FROM people")
def a9(spark, d):
    calls = V.calls(spark, d)
    return A.call_person_stats(calls).join(A.contact_sets(calls).select("person", "part", joined("contacts").alias("names")), "person")


@query("a10_session_person_stats", PROF + f"SELECT person, sessions, round(mb, 4) AS mb, seconds, days, timed, night, weekend, {joined_sql('cells')}, {joined_sql('dest', 'destinations')}, {joined_sql('ports')}, {joined_sql('buckets')}, array_to_string(hours, '|') AS hours FROM prof")
def a10(spark, d):
    s = A.session_person_stats(V.sessions(spark, d))
    return s.select("person", "sessions", F.round("mb", 4).alias("mb"), "seconds", "days", "timed", "night", "weekend", *[joined(c) for c in ("cells", "destinations", "ports", "buckets")], F.array_join(F.transform("hours", lambda x: x.cast("string")), "|").alias("hours"))


@query("a11_hourly_rate_pattern", ", t AS (SELECT count(*) AS total, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 1) AS days FROM ev) SELECT h::INT AS hour, " + q6("count(u) * 24 / total::DOUBLE", "multiplier") + ", " + q6("total / (500 * days * 24)", "base_rate") + " FROM range(24) r(h) LEFT JOIN ev ON hour(ts) = h, t GROUP BY h, total, days")
def a11(spark, d):
    p = A.hourly_rate_pattern(V.calls(spark, d), 500)
    return p.select("hour", r6(F.col("multiplier"), "multiplier"), r6(F.col("base_rate"), "base_rate"))


AGENTS = ", agents AS (SELECT subscriber_id AS person FROM subscribers WHERE subscriber_id::INT % 3 <> 1 UNION SELECT 'nobody')"


def _agents(spark, d):
    s = V.subscribers(spark, d).where("cast(subscriber_id AS int) % 3 <> 1").select(F.col("subscriber_id").alias("person"))
    return s.unionByName(spark.range(1).select(F.lit("nobody").alias("person")))


@query("a12_call_behaviour", AGENTS + ", b AS (SELECT caller, count(*) AS calls, count(DISTINCT hour(ts)) AS h, count(DISTINCT duration) AS du, count(DISTINCT receiver) FILTER (receiver IN (SELECT person FROM agents)) AS c FROM calls WHERE caller IN (SELECT person FROM agents) GROUP BY 1), g AS (SELECT count(DISTINCT hour(ts)) AS gh, count(DISTINCT duration) AS gd FROM calls) SELECT person AS agent, coalesce(calls, 0) AS calls, coalesce(h, gh) AS n_hours, coalesce(du, gd) AS n_durations, coalesce(c, 0) AS contacts, " + q6("coalesce(c, 0) / greatest(coalesce(calls, 0), 1)::DOUBLE", "share") + " FROM agents LEFT JOIN b ON caller = person, g")
def a12(spark, d):
    b = A.call_behaviour(V.calls(spark, d), _agents(spark, d))
    return b.select("agent", "calls", "n_hours", "n_durations", "contacts", r6(F.col("share"), "share"))


@query("a13_session_behaviour", AGENTS + ", b AS (SELECT subscriber, count(*) AS n, count(DISTINCT hour(ts)) AS h, count(DISTINCT destination) AS de, avg(mb) AS mb, count(DISTINCT port) AS po FROM sessions GROUP BY 1) SELECT person AS agent, coalesce(n, 0) AS sessions, coalesce(h, 24) AS n_hours, coalesce(de, 4) AS n_destinations, round(coalesce(mb, 5.0), 4) AS mb, coalesce(po, 16) AS n_ports, n IS NULL AS neutral FROM agents LEFT JOIN b ON subscriber = person")
def a13(spark, d):
    return A.session_behaviour(V.sessions(spark, d), _agents(spark, d)).withColumn("mb", F.round("mb", 4))


@query("a14_value_weights", "SELECT subscriber, destination, count(*) AS n, " + "round(count(*) / (sum(count(*)) OVER (PARTITION BY subscriber)) + 1e-9, 6) AS weight" + " FROM sessions GROUP BY subscriber, destination")
def a14(spark, d):
    return A.value_weights(V.sessions(spark, d), "subscriber", "destination").select("subscriber", "destination", "n", r6(F.col("weight"), "weight"))


@query("a15_activity_ranking", "SELECT caller AS person, count(*) AS calls FROM calls GROUP BY 1")
def a15(spark, d):
    return A.activity_ranking(V.calls(spark, d))


@query("a16_distinct_edges", AGENTS + "SELECT lo, hi FROM pairs WHERE lo IN (SELECT person FROM agents) AND hi IN (SELECT person FROM agents)")
def a16(spark, d):
    return G.distinct_edges(V.calls(spark, d), _agents(spark, d))


@query("a17_node_condition", f", e AS (SELECT lo, hi, ({draw_sql(7, 'lo', 'hi')} < 0.05)::INT AS r FROM pairs), b AS (SELECT lo AS node, r FROM e UNION ALL SELECT hi, r FROM e) SELECT node, count(*) AS degree, {q6('sum(r) / count(*)::DOUBLE', 'condition')} FROM b GROUP BY 1")
def a17(spark, d):
    return G.node_condition(V.pairs(spark, d), 0.05).select("node", "degree", r6(F.col("condition"), "condition"))


@query("a18_best_score_per_pair", "SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, max(duration) AS score FROM calls GROUP BY ALL")
def a18(spark, d):
    return G.best_score_per_pair(V.calls(spark, d), "caller", "receiver", "duration")


@query("a31_label_conflicts", "SELECT lo, hi, 2::BIGINT AS labels FROM (SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, count(DISTINCT k % 2) AS n FROM calls GROUP BY ALL) WHERE n > 1")
def a31(spark, d):
    return G.label_conflicts(V.calls(spark, d).select(F.col("caller").alias("person_a"), F.col("receiver").alias("person_b"), (F.col("k") % 2).alias("label")))


@query("x3_validate_pairs", ", p AS (SELECT CASE WHEN event_id % 9 = 0 THEN '' ELSE caller END AS a, CASE WHEN event_id % 9 = 1 THEN caller ELSE receiver END AS b, k % 2 AS label FROM calls), c AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM p GROUP BY ALL HAVING count(DISTINCT label) > 1), r AS (SELECT CASE WHEN a = '' OR b = '' THEN 'blank_id' WHEN a = b THEN 'self_pair' WHEN (least(a, b), greatest(a, b)) IN (SELECT (lo, hi) FROM c) THEN 'label_conflict' END AS reason FROM p) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def x3(spark, d):
    k = F.col("event_id") % 9
    p = V.calls(spark, d).select(F.when(k == 0, "").otherwise(F.col("caller")).alias("person_a"), F.when(k == 1, F.col("caller")).otherwise(F.col("receiver")).alias("person_b"), (F.col("k") % 2).alias("label"))
    return G.pair_violations(p).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("j3_attach_pair_events", "SELECT event_id, least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, (caller > receiver)::INT AS direction FROM calls WHERE (least(caller, receiver), greatest(caller, receiver)) IN (SELECT (lo, hi) FROM observed)")
def j3(spark, d):
    return A.attach_pair_events(V.observed(spark, d), V.calls(spark, d)).select("event_id", "lo", "hi", "direction")


@query("j4_attach_profiles", PROF + "SELECT lo, hi, " + ", ".join(f"{s}.sessions AS {s}_sessions, {joined_sql(f'{s}.dest', f'{s}_destinations')}, {joined_sql(f'{s}.ports', f'{s}_ports')}, {joined_sql(f'{s}.buckets', f'{s}_buckets')}, array_to_string({s}.hours, '|') AS {s}_hours" for s in "ab") + " FROM pairs LEFT JOIN prof a ON a.person = lo LEFT JOIN prof b ON b.person = hi")
def j4(spark, d):
    p = A.attach_profiles(V.pairs(spark, d), A.session_profiles(V.sessions(spark, d)))
    hours = [F.array_join(F.transform(f"{s}_hours", lambda x: x.cast("string")), "|").alias(f"{s}_hours") for s in "ab"]
    return p.select("lo", "hi", "a_sessions", "b_sessions", *hours, *[joined(f"{s}_{c}") for s in "ab" for c in ("destinations", "ports", "buckets")])


@query("j5_all_pairs", "SELECT a.subscriber_id AS lo, b.subscriber_id AS hi FROM subscribers a JOIN subscribers b ON a.subscriber_id < b.subscriber_id")
def j5(spark, d):
    return K.all_pairs(V.subscribers(spark, d).select(F.col("subscriber_id").alias("person")))


ITEMS = ", items AS (SELECT DISTINCT subscriber AS person, unnest(['destination', 'port', 'bucket']) AS kind, unnest([destination, port, epoch(date_trunc('hour', ts))::BIGINT::VARCHAR]) AS item FROM sessions), dfs AS (SELECT kind, item, count(*) AS df FROM items GROUP BY ALL)"


@query("j6_candidate_pairs", ITEMS + ", i AS (SELECT person, kind, item FROM items JOIN dfs USING (kind, item) WHERE df <= 12) SELECT DISTINCT a.person AS lo, b.person AS hi FROM i a JOIN i b USING (kind, item) WHERE a.person < b.person")
def j6(spark, d):
    return K.candidate_pairs(V.sessions(spark, d), 12)


_SCORE = " + ".join(f"{w} * ({x})" for w, x in ((0.35, jac("a.dest", "b.dest")), (0.15, jac("a.ports", "b.ports")), (0.25, jac("a.buckets", "b.buckets")), (0.25, cos("a.hours", "b.hours"))))
_SHARED = "len(list_intersect(a.dest, b.dest))::BIGINT AS shared_destination, len(list_intersect(a.ports, b.ports))::BIGINT AS shared_port, len(list_intersect(a.buckets, b.buckets))::BIGINT AS shared_bucket"


@query("k1_correlate_sessions", PROF + f"SELECT a.person AS lo, b.person AS hi, round({_SCORE} + 1e-9, 6) AS score, {_SHARED} FROM prof a JOIN prof b ON a.person < b.person")
def k1(spark, d):
    return K.correlate_sessions(V.sessions(spark, d)).drop("evidence")


def _both(x):
    """SQL of a session feature: 0 unless both people have sessions."""
    return f"CASE WHEN x.sessions IS NULL OR y.sessions IS NULL THEN 0 ELSE {x} END"


def _alike(a, b):
    return f"CASE WHEN greatest({a}, {b}) > 0 THEN least({a}, {b}) / greatest({a}, {b})::DOUBLE ELSE 0 END"


def _none(c):
    return f"coalesce(x.{c}, 0)::DOUBLE", f"coalesce(y.{c}, 0)::DOUBLE"


# the 39 features in order, over the prelude's tables: s (pair), a and b (people's calls), x and y (people's sessions)
_FEATURES = [
    "(s.n > 0)::INT", "s.n", "least(d0, d1)", "greatest(d0, d1)", "2 * least(d0, d1) / s.n::DOUBLE", "abs(d0 - d1) / s.n::DOUBLE", "dur", "dur / s.n", "dur_max", "sqrt(greatest(dur2 / s.n - (dur / s.n) * (dur / s.n), 0))",
    "s.days", "(epoch_us(l) - epoch_us(f)) / 86400e6", "s.n / s.days::DOUBLE", "s.night / s.n::DOUBLE", "s.weekend / s.n::DOUBLE", "s.voice / s.n::DOUBLE", "least(s.n / a.events::DOUBLE, s.n / b.events::DOUBLE)", "greatest(s.n / a.events::DOUBLE, s.n / b.events::DOUBLE)",
    "least(len(a.contacts), len(b.contacts))", "greatest(len(a.contacts), len(b.contacts))", "len(list_intersect(a.contacts, b.contacts))", jac("a.contacts", "b.contacts"), "(x.sessions IS NOT NULL AND y.sessions IS NOT NULL)::INT",
    "least({}, {})".format(*_none("sessions")), "greatest({}, {})".format(*_none("sessions")), _alike(*_none("sessions")), "least({}, {})".format(*_none("mb")), "greatest({}, {})".format(*_none("mb")), _alike(*_none("mb")),
    _both(_alike("x.seconds / x.sessions", "y.seconds / y.sessions")), "least({}, {})".format(*_none("days")), "greatest({}, {})".format(*_none("days")), _both(cos("x.hours", "y.hours")),
    _both(jac("x.dest", "y.dest")), _both(jac("x.ports", "y.ports")), _both(jac("x.cells", "y.cells")), _both(jac("x.buckets", "y.buckets")),
    _both("1 - abs(x.night / x.timed::DOUBLE - y.night / y.timed::DOUBLE)"), _both("1 - abs(x.weekend / x.timed::DOUBLE - y.weekend / y.timed::DOUBLE)"),
]
#: Digits that are compared: fewer for sums of many products.
_DIGITS = {6: 4, 7: 4, 8: 4, 9: 3, 26: 3, 27: 3}
_FEATURE_SQL = "SELECT p.lo, p.hi, " + ", ".join(f"round(({x})::DOUBLE + 1e-9, {_DIGITS.get(k, 6)}) AS {A.FEATURES[k]}" for k, x in enumerate(_FEATURES)) + " FROM pairs p JOIN stats s USING (lo, hi) LEFT JOIN people a ON a.person = lo LEFT JOIN people b ON b.person = hi LEFT JOIN prof x ON x.person = lo LEFT JOIN prof y ON y.person = hi"


@query("k2_pair_features", PROF + _FEATURE_SQL)
def k2(spark, d):
    f = A.pair_features(V.pairs(spark, d).select("lo", "hi"), V.calls(spark, d), V.sessions(spark, d))
    return f.select("lo", "hi", *[F.round(F.col(c) + 1e-9, _DIGITS.get(k, 6)).alias(c) for k, c in enumerate(A.FEATURES)])


@query("a25_pair_coverage", PROF + "SELECT count(*) AS pairs, count(*) AS with_calls, count(*) FILTER (lo IN (SELECT person FROM prof) AND hi IN (SELECT person FROM prof)) AS with_sessions FROM pairs")
def a25(spark, d):
    return A.pair_coverage(A.pair_features(V.pairs(spark, d).select("lo", "hi"), V.calls(spark, d), V.sessions(spark, d)))


IDF = ITEMS + ", np AS (SELECT count(DISTINCT person) AS n FROM items WHERE kind <> 'bucket'), idf AS (SELECT kind, item, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM dfs, np WHERE kind <> 'bucket')"


@query("k3_item_rarity", IDF + "SELECT kind, item, df, round(idf, 5) AS idf FROM idf")
def k3(spark, d):
    return K.item_rarity(V.sessions(spark, d)).withColumn("idf", F.round("idf", 5))


@query("k4_weighted_item_cosine", IDF + ", w AS (SELECT person, kind, item, idf FROM items JOIN idf USING (kind, item)), nr AS (SELECT person, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY 1), dt AS (SELECT a.person AS lo, b.person AS hi, sum(a.idf * b.idf) AS dot FROM w a JOIN w b USING (kind, item) WHERE a.person < b.person GROUP BY ALL) SELECT lo, hi, round(dot / (x.norm * y.norm), 5) AS cosine FROM dt JOIN nr x ON x.person = lo JOIN nr y ON y.person = hi")
def k4(spark, d):
    return K.weighted_item_cosine(V.sessions(spark, d)).withColumn("cosine", F.round("cosine", 5))


@query("k5_hour_distance", PROF + f", c AS (SELECT person, generate_subscripts(hours, 1) AS h, sessions, unnest(hours) AS n FROM prof), cdf AS (SELECT person, h, sum(n) OVER (PARTITION BY person ORDER BY h) / sessions::DOUBLE AS f FROM c) SELECT lo, hi, round(sum(abs(x.f - y.f)), 5) AS distance FROM pairs JOIN cdf x ON x.person = lo JOIN cdf y ON y.person = hi AND y.h = x.h GROUP BY ALL")
def k5(spark, d):
    prof = A.session_profiles(V.sessions(spark, d)).select("person", "hours")
    both = A.attach_profiles(V.pairs(spark, d), prof).where("a_hours IS NOT NULL AND b_hours IS NOT NULL")
    return both.select("lo", "hi", F.round(K.hour_distance(F.col("a_hours"), F.col("b_hours")), 5).alias("distance"))


@query("k6_rare_item_bonus", IDF + ", w AS (SELECT person, kind, item, idf FROM items JOIN idf USING (kind, item) WHERE df BETWEEN 2 AND 20) SELECT a.person AS lo, b.person AS hi, round(least(sum(a.idf), 10.0), 5) AS bonus FROM w a JOIN w b USING (kind, item) WHERE a.person < b.person GROUP BY ALL")
def k6(spark, d):
    return K.rare_item_bonus(V.sessions(spark, d), 20).withColumn("bonus", F.round("bonus", 5))


@query("k7_adaptive_weights", ", s AS (SELECT stddev_pop(duration) AS a, stddev_pop(k::DOUBLE) AS b FROM calls), r AS (SELECT 'duration' AS signal, 0.6 * (0.5 + 0.5 * a / (a + b) * 2) AS raw FROM s UNION ALL SELECT 'k', 0.4 * (0.5 + 0.5 * b / (a + b) * 2) FROM s) SELECT signal, round(raw / sum(raw) OVER (), 5) AS weight FROM r")
def k7(spark, d):
    return K.adaptive_weights(V.calls(spark, d), ["duration", "k"], [0.6, 0.4]).withColumn("weight", F.round("weight", 5))


@query("k8_score_category", "SELECT id, CASE WHEN p >= 0.7 THEN 'probable_positive' WHEN p <= 0.25 THEN 'probable_negative' ELSE 'uncertain' END AS category FROM scores")
def k8(spark, d):
    return V.scores(spark, d).select("id", K.score_category(F.col("p")).alias("category"))


@query("k9_apply_reviews", ", rv AS (SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, arg_max((k % 2)::INT, ts) AS reviewed FROM calls WHERE k > 80 GROUP BY ALL) SELECT lo, hi, coalesce(reviewed, label)::INT AS label, CASE WHEN reviewed IS NULL THEN 'source' ELSE 'analyst_review' END AS provenance FROM pairs LEFT JOIN rv USING (lo, hi)")
def k9(spark, d):
    r = V.calls(spark, d).where("k > 80").select(F.least("caller", "receiver").alias("lo"), F.greatest("caller", "receiver").alias("hi"), (F.col("k") % 2).cast("int").alias("label"), "ts")
    return K.apply_reviews(V.pairs(spark, d), r)


# ---- edges


@query("j11_endpoint_attributes", "SELECT lo, hi, a.msisdn AS msisdn_u, a.region AS region_u, b.msisdn AS msisdn_v, b.region AS region_v FROM pairs JOIN subscribers a ON a.subscriber_id = lo JOIN subscribers b ON b.subscriber_id = hi")
def j11(spark, d):
    return G.attach_endpoint_attributes(V.pairs(spark, d).select("lo", "hi"), V.subscribers(spark, d), ["msisdn", "region"])


MERGED = ", merged AS (SELECT lo, hi, CASE WHEN o.x AND i.score IS NOT NULL THEN 'observed+inferred' WHEN o.x THEN 'observed' ELSE 'inferred' END AS source, coalesce(o.x, false) AS is_observed, i.score IS NOT NULL AS is_inferred, i.score FROM (SELECT *, true AS x FROM observed) o FULL JOIN inferred i USING (lo, hi))"


def _merged(spark, d):
    return G.merge_edge_sources(V.observed(spark, d), V.inferred(spark, d))


@query("j12_merge_edge_sources", MERGED + "SELECT * FROM merged")
def j12(spark, d):
    return _merged(spark, d)


@query("j13_agent_friend_edges", MERGED + "SELECT agent, friend, source, s.region AS friend_region FROM (SELECT lo AS agent, hi AS friend, source FROM merged UNION ALL SELECT hi, lo, source FROM merged) JOIN subscribers s ON s.subscriber_id = friend WHERE agent IN (SELECT subscriber_id FROM subscribers)")
def j13(spark, d):
    return G.agent_friend_edges(_merged(spark, d).select("lo", "hi", "source"), V.subscribers(spark, d), ["region"]).select("agent", "friend", "source", "friend_region")


@query("j14_annotate_contacts", MERGED + ", ct AS (SELECT DISTINCT caller AS agent, receiver AS other FROM calls) SELECT agent, other, score AS edge_score, source AS edge_source, source IS NOT NULL AS known FROM ct LEFT JOIN merged ON lo = least(agent, other) AND hi = greatest(agent, other)")
def j14(spark, d):
    contacts = V.calls(spark, d).select(F.col("caller").alias("agent"), F.col("receiver").alias("other")).distinct()
    return G.annotate_contacts(contacts, _merged(spark, d))


@query("j15_temporal_coincidences", ", hit AS (SELECT c.event_id, any_value(caller) AS caller, any_value(receiver) AS receiver FROM calls c JOIN sessions a ON a.subscriber = c.caller AND abs(epoch_us(a.ts) - epoch_us(c.ts)) <= 1800000000 JOIN sessions b ON b.subscriber = c.receiver AND abs(epoch_us(b.ts) - epoch_us(c.ts)) <= 1800000000 GROUP BY 1) SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, count(*) AS coincidences FROM hit GROUP BY ALL")
def j15(spark, d):
    return G.temporal_coincidences(V.calls(spark, d), V.sessions(spark, d), 1800)


@query("j16_exclude_known_edges", "SELECT lo, hi FROM inferred EXCEPT SELECT lo, hi FROM observed")
def j16(spark, d):
    return G.exclude_known_edges(V.inferred(spark, d), V.observed(spark, d)).select("lo", "hi")


@query("o3_union_edges", "SELECT lo, hi FROM observed UNION SELECT lo, hi FROM inferred")
def o3(spark, d):
    return G.union_edges(V.observed(spark, d), V.inferred(spark, d))


@query("o4_union_truth", "SELECT lo, hi, 1 AS label, lo AS person_a, hi AS person_b, 'friend_or_interacting' AS truth_label FROM observed UNION ALL SELECT lo, hi, 0, lo, hi, 'not_friend_or_interacting' FROM (SELECT lo, hi FROM inferred EXCEPT SELECT lo, hi FROM observed)")
def o4(spark, d):
    return G.union_truth(V.observed(spark, d), G.exclude_known_edges(V.inferred(spark, d), V.observed(spark, d)).select("lo", "hi"))


@query("w1_sequential_ids", "SELECT lo, hi, 'FRIEND_' || lpad((row_number() OVER (ORDER BY lo, hi) - 1)::VARCHAR, 7, '0') AS row_id FROM pairs")
def w1(spark, d):
    return G.sequential_ids(V.pairs(spark, d).select("lo", "hi"), ["lo", "hi"], "FRIEND_")


@query("w2_first_per_key", "SELECT caller, event_id, receiver FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY ts, event_id) AS k1 FROM calls) WHERE k1 = 1")
def w2(spark, d):
    return G.first_per_key(V.calls(spark, d), ["caller"], ["ts", "event_id"]).select("caller", "event_id", "receiver")


@query("w6_top_fraction", "SELECT event_id, duration FROM calls ORDER BY duration DESC, event_id LIMIT (SELECT (count(*) * 0.01)::INT FROM calls)")
def w6(spark, d):
    return G.top_fraction(V.calls(spark, d).select("event_id", "duration"), "duration", 0.01, ties=("event_id",))


@query("w7_order_edges", MERGED + "SELECT * FROM merged ORDER BY is_inferred DESC, score DESC NULLS LAST, lo, hi")
def w7(spark, d):
    return G.order_edges(_merged(spark, d))


@query("w8_paginate", "SELECT event_id, caller FROM calls ORDER BY event_id LIMIT 24 OFFSET 48")
def w8(spark, d):
    return G.paginate(V.calls(spark, d).select("event_id", "caller"), ["event_id"], 2, 24)


@query("x1_check_keys", "SELECT 'pk:nation.n_nationkey' AS \"constraint\", 0::BIGINT AS violations UNION ALL SELECT 'pk:region.r_regionkey', 0 UNION ALL SELECT 'pk:customer.c_custkey', count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey) UNION ALL SELECT 'fk:nation.n_regionkey->region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'fk:customer.c_nationkey->nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'fk:orders.o_custkey->customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def x1(spark, d):
    t = {n: V.table(spark, d, n) for n in ("nation", "region", "customer", "orders")}
    return G.key_violations(t, {"nation": "n_nationkey", "region": "r_regionkey", "customer": "c_custkey"}, [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer")])
