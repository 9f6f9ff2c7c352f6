"""Queries: resampling, checked by counts, supports and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringdata.operators import profiles as A
from ringdata.operators import sampling as R
from ringdata.plans.q_pairs import draw_sql, hash_sql
from ringdata.plans.registry import query
from ringdata.sources import views as V

PLAN = ", src AS (SELECT caller AS person, count(*) AS calls FROM calls GROUP BY 1), rk AS (SELECT person, row_number() OVER (ORDER BY calls DESC, person) - 1 AS r, (SELECT count(*) FROM src) AS n FROM src)"


def _sources(spark, d):
    return A.activity_ranking(V.calls(spark, d))


def _plan(spark, d):
    s = _sources(spark, d)
    return R.plan_profiles(s, s.count() + 50)


@query("r1_plan_profiles", PLAN + ", x AS (SELECT 'SYNTHETIC_AGENT_' || lpad((i + 1)::VARCHAR, 7, '0') AS agent_id, (i + 7 % n) % n AS r FROM range(50) t(i), (SELECT count(*) AS n FROM src)) SELECT person AS agent_id, person AS source_id, false AS is_extra FROM rk UNION ALL SELECT agent_id, person, true FROM x JOIN rk USING (r)")
def r1(spark, d):
    return _plan(spark, d)


@query("r1_plan_top", PLAN + "SELECT person AS agent_id, person AS source_id, false AS is_extra FROM rk WHERE r < 10")
def r1b(spark, d):
    return R.plan_profiles(_sources(spark, d), 10)


@query("r2_inherit_profiles", PLAN + ", x AS (SELECT 'SYNTHETIC_AGENT_' || lpad((i + 1)::VARCHAR, 7, '0') AS agent_id, (i + 7 % n) % n AS r FROM range(50) t(i), (SELECT count(*) AS n FROM src)), p AS (SELECT person AS agent_id, person FROM rk UNION ALL SELECT agent_id, person FROM x JOIN rk USING (r)), h AS (SELECT caller, hour(ts)::INT AS hour, count(*) AS n FROM calls GROUP BY ALL) SELECT agent_id, hour, h.n FROM p JOIN h ON caller = person")
def r2(spark, d):
    hours = V.calls(spark, d).groupBy(F.col("caller").alias("person"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return R.inherit_profiles(hours, _plan(spark, d))


@query("r3_resample_events", PLAN + "SELECT count(*) + 50 AS agents, 20::BIGINT AS least, 20::BIGINT AS most, true AS supported, true AS in_range FROM src")
def r3(spark, d):
    c = V.calls(spark, d).withColumn("hour", F.hour("ts"))
    plan = _plan(spark, d)
    e = R.resample_events(plan, {"hour": (c, "caller", "hour"), "duration": (c, "caller", "duration")}, 20)
    seen = c.select(F.col("caller").alias("person"), F.col("duration").cast("string").alias("duration"), F.lit(True).alias("seen")).distinct()
    e = e.join(seen, ["person", "duration"], "left").withColumn("ok", (F.hour("ts") == F.col("hour").cast("int")) & F.col("ts").between(F.lit(R.START).cast("timestamp"), F.lit("2026-06-22 00:00:00").cast("timestamp")))
    per = e.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("seen", F.lit(False))).alias("s"), F.bool_and("ok").alias("r"))
    return per.agg(F.count(F.lit(1)).alias("agents"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_and("s").alias("supported"), F.bool_and("r").alias("in_range"))


def _rows(spark, d):
    return V.calls(spark, d).select(F.col("caller").alias("agent"), F.col("event_id").alias("i"))


BOTH = ", b AS (SELECT lo AS node, hi AS other FROM observed UNION ALL SELECT hi, lo FROM observed)"
RANKED = "SELECT *, row_number() OVER (PARTITION BY agent ORDER BY value) - 1 AS at, count(*) OVER (PARTITION BY agent) AS n FROM (SELECT DISTINCT {} AS value FROM {})"


@query("r4_route_calls", BOTH + f""", c AS ({RANKED.format("caller AS agent, receiver", "calls")}), f AS ({RANKED.format("node AS agent, other", "b")}),
x AS (SELECT caller AS agent, event_id AS i, {draw_sql(7, "'link'", "caller", "event_id")} < 0.5 AS linked, {draw_sql(7, "'contact'", "caller", "event_id")} AS uc, {draw_sql(7, "'near'", "caller", "event_id")} AS uf FROM calls)
SELECT x.agent, i, CASE WHEN linked THEN coalesce(c.value, f.value, x.agent) ELSE 'DUMMY_' || x.agent || '_' || lpad((i // 2)::VARCHAR, 6, '0') END AS receiver, CASE WHEN linked THEN 'known_friend' ELSE 'dummy_entity' END AS contact_type
FROM x LEFT JOIN c ON c.agent = x.agent AND c.at = floor(uc * c.n) LEFT JOIN f ON f.agent = x.agent AND f.at = floor(uf * f.n)""")
def r4(spark, d):
    contacts = V.calls(spark, d).select(F.col("caller").alias("agent"), F.col("receiver").alias("contact"))
    shares = V.subscribers(spark, d).select(F.col("subscriber_id").alias("agent"), F.lit(0.5).alias("share"))
    return R.route_calls(_rows(spark, d), shares, contacts, V.observed(spark, d))


@query("r5_sample_neighbor", BOTH + f", m AS (SELECT node, arg_min(other, {hash_sql(7, 'node', 'other')}) AS other FROM b GROUP BY 1) SELECT subscriber_id AS node, coalesce(other, subscriber_id) AS neighbor FROM subscribers LEFT JOIN m ON node = subscriber_id")
def r5(spark, d):
    return R.sample_neighbor(_nodes(spark, d), V.observed(spark, d))


@query("r6_bounded_reuse_ids", ", r AS (SELECT caller AS agent, event_id AS i, (row_number() OVER (PARTITION BY caller ORDER BY event_id) - 1) // 2 AS n FROM calls) SELECT agent, i, 'DUMMY_' || agent || '_' || lpad(n::VARCHAR, 6, '0') AS dummy_id FROM r")
def r6_(spark, d):
    return R.bounded_reuse_ids(_rows(spark, d), "agent", ["i"])


def _nodes(spark, d):
    return V.subscribers(spark, d).select(F.col("subscriber_id").alias("node"))


#: The walk over all pairs; {} is the number of places.
WALK = f""", nodes AS (SELECT subscriber_id AS node, row_number() OVER (ORDER BY {hash_sql(7, "subscriber_id")}, subscriber_id) - 1 AS at FROM subscribers), total AS (SELECT count(*) * (count(*) - 1) // 2 AS p FROM nodes),
step AS (SELECT p, min(s) AS s FROM total, unnest(range(greatest(1, p * {R.GOLDEN} // 1000000000), greatest(1, p * {R.GOLDEN} // 1000000000) + 1000)) t(s) WHERE gcd(s, p) = 1 GROUP BY 1),
ranked AS (SELECT b.at * (b.at - 1) // 2 + a.at AS k, least(a.node, b.node) AS lo, greatest(a.node, b.node) AS hi FROM nodes a JOIN nodes b ON b.at > a.at),
seats AS (SELECT id, ((id::HUGEINT * s + 7 * 7919) % p)::BIGINT AS k FROM step, unnest(range(0, {{}})) t(id)), walk AS (SELECT id, lo, hi FROM seats JOIN ranked USING (k))"""


@query("r7_sample_non_edges", WALK.format("least(p, 500 + (SELECT count(*) FROM observed))") + "SELECT lo, hi FROM walk ANTI JOIN observed USING (lo, hi) ORDER BY id LIMIT 500")
def r7(spark, d):
    return R.sample_non_edges(_nodes(spark, d), V.observed(spark, d), 500)


@query("r8_sample_pairs_fraction", WALK.format("greatest(1, round_even(0.01 * p, 0)::BIGINT)") + "SELECT lo, hi FROM walk")
def r8(spark, d):
    return R.sample_pairs_fraction(_nodes(spark, d), 0.01)


@query("r9_friend_adjacency", ", b AS (SELECT lo AS node, hi AS other FROM observed UNION ALL SELECT hi, lo FROM observed) SELECT node, 0 AS part, string_agg(other, ',' ORDER BY other) AS friends, CASE WHEN node IN (SELECT subscriber_id FROM subscribers WHERE region = 'ASIA') THEN 0.3 ELSE 0 END::DOUBLE AS share FROM b GROUP BY 1")
def r9(spark, d):
    share = V.subscribers(spark, d).where("region = 'ASIA'").select(F.col("subscriber_id").alias("node"), F.lit(0.3).alias("share"))
    return R.friend_adjacency(V.observed(spark, d), share).select("node", "part", F.array_join("friends", ",").alias("friends"), "share")


DRAWS = ", ".join(f"{draw_sql(7, repr(x), 'c_custkey')} AS {x[0:2]}" for x in ("circle", "device", "tier", "tower")).replace("AS to", "AS tow")


@query("r10_assign_weighted", f""", u AS (SELECT c_custkey, {DRAWS} FROM customer), c AS (SELECT *, CASE WHEN ci < 0.2 THEN 'MH' WHEN ci < 0.35 THEN 'DL' WHEN ci < 0.5 THEN 'KA' WHEN ci < 0.8 THEN 'UP' ELSE 'WB' END AS circle, ci < 0.5 AS first FROM u)
SELECT c_custkey, circle, CASE WHEN first AND de < 0.5 THEN '5G' WHEN first OR de < 0.5 THEN '4G' ELSE '2G' END AS device, CASE WHEN first AND ti < 0.5 THEN 'premium' ELSE 'basic' END AS tier, 'TOWER_' || circle || '_' || (1000 + floor(tow * 500)::INT) AS tower FROM c""")
def r10(spark, d):
    return R.assign_weighted(V.table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("r11_route_tower", "SELECT event_id, hour(ts) >= 18 AS evening FROM calls")
def r11(spark, d):
    s = V.subscribers(spark, d).select(F.col("subscriber_id").alias("caller"), "circle", F.concat(F.lit("TOWER_"), "circle", F.lit("_"), F.substring("tower", 2, 4)).alias("tower"))
    r = R.route_tower(V.calls(spark, d).join(s, "caller"), ["event_id"])
    return r.select("event_id", (F.substring_index("routing_tower", "_", -1).cast("int") >= 2000).alias("evening"))


@query("r12_score_and_keep", ", c AS (SELECT caller AS a, CASE WHEN event_id % 4 = 0 THEN caller ELSE receiver END AS b, duration AS score FROM calls), k AS (SELECT * FROM c WHERE a <> b ORDER BY score DESC, a, b LIMIT (SELECT (count(*) * 0.1)::INT FROM c)) SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(score) AS score FROM k GROUP BY ALL")
def r12(spark, d):
    c = V.calls(spark, d).select(F.col("caller").alias("a"), F.when(F.col("event_id") % 4 == 0, F.col("caller")).otherwise(F.col("receiver")).alias("b"), F.col("duration").alias("score"))
    return R.score_and_keep(c, "score", 0.1)


@query("r13_truth_pairs", ", p AS (SELECT count(*) AS p FROM observed), n AS (SELECT count(*) AS n FROM subscribers), e AS (SELECT count(*) AS e FROM observed WHERE lo IN (SELECT subscriber_id FROM subscribers) AND hi IN (SELECT subscriber_id FROM subscribers)) SELECT 1 AS label, p AS pairs FROM p UNION ALL SELECT 0, least(p, n * (n - 1) // 2 - e) FROM p, n, e")
def r13(spark, d):
    t = R.truth_pairs(_nodes(spark, d), V.observed(spark, d), 1.0)
    return t.groupBy("label").agg(F.count_distinct("truth_pair_id").alias("pairs"))


@query("r14_export_calls", "SELECT (row_number() OVER (ORDER BY event_id))::BIGINT AS sl, a.msisdn AS mobile, receiver AS other, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%H:%M:%S') AS clock, a.imei, 26::INT AS columns FROM calls JOIN subscribers a ON a.subscriber_id = caller")
def r14(spark, d):
    c = V.calls(spark, d).select("event_id", "caller", "receiver", "ts", "duration", F.lit("T1").alias("tower"))
    e = R.export_call_schema(c, V.subscribers(spark, d))
    return e.select(F.col("SL_NO").alias("sl"), F.col("Mobile_No").alias("mobile"), F.col("Other_Party_No").alias("other"), F.col("Call_Date").alias("day"), F.col("`Call_Initiation_Time(CIT)`").alias("clock"), F.col("IMEI").alias("imei"), F.lit(len(e.columns)).alias("columns"))


@query("r15_export_sessions", "SELECT subscriber AS u, a.msisdn, strftime(ts, '%Y/%m/%d %H:%M:%S') AS t, floor(mb * 1024 * 0.4)::INT AS up, floor(mb * 1024 * 0.6)::INT AS down, 31::INT AS columns FROM sessions JOIN subscribers a ON a.subscriber_id = subscriber")
def r15(spark, d):
    e = R.export_session_schema(V.sessions(spark, d), V.subscribers(spark, d))
    return e.select(
        F.col("User Id for internet Access based on authentication").alias("u"), F.col("`Landline/MSISDN/MDN/Leased Circuit ID for Internet Access`").alias("msisdn"), F.col("TIME1 (dd/MM/yyyy HH:mm:ss)").alias("t"),
        F.col("Data Volume Up Link").alias("up"), F.col("Data Volume Down Link").alias("down"), F.lit(len(e.columns)).alias("columns"),
    )
