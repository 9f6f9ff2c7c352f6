"""Queries: per-agent reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringdata.operators import edges as G
from ringdata.operators import reports as R
from ringdata.plans.q_basic import DUCK_ISO, _scratch, iso
from ringdata.plans.q_pairs import q6, r6
from ringdata.plans.registry import query
from ringdata.sources import files
from ringdata.sources import views as V
from ringdata.sources.tables import stored

ENDS = ", ends AS (SELECT caller AS agent, receiver AS other, 'outgoing' AS dir, ts, duration, event_type FROM calls UNION ALL SELECT receiver, caller, 'incoming', ts, duration, event_type FROM calls)"


def _agents(spark, d):
    return V.subscribers(spark, d).select(F.col("subscriber_id").alias("agent"), "circle", "region", F.col("subscriber_id").alias("person"))


@query("a19_contact_summary", ENDS + f"SELECT agent, other, count(*) FILTER (dir = 'outgoing') AS outgoing, count(*) FILTER (dir = 'incoming') AS incoming, round(sum(duration), 4) AS seconds, strftime(max(ts), {DUCK_ISO}) AS last_ts, arg_max(event_type, ts) AS last_type FROM ends GROUP BY ALL")
def a19(spark, d):
    return R.contact_summary(V.calls(spark, d)).withColumn("seconds", F.round("seconds", 4)).withColumn("last_ts", iso("last_ts"))


def _located(spark, d):
    k = F.col("k")
    return V.calls(spark, d).select(F.col("caller").alias("agent"), (k / 4 + 5.0).alias("lat"), (k % 40 + 66.25).alias("lng"), F.when(k % 3 == 0, " ").otherwise("A").alias("tower1"), F.when(k % 2 == 0, "").otherwise("B").alias("tower2"), F.lit(None).cast("string").alias("tower3"), "ts")


POINTS = ", pts AS (SELECT caller AS agent, k / 4.0 + 5.0 AS lat, k % 40 + 66.25 AS lng, CASE WHEN k % 3 <> 0 THEN 'A' WHEN k % 2 <> 0 THEN 'B' ELSE 'Unknown tower' END AS tower, ts FROM calls WHERE k / 4.0 + 5.0 BETWEEN 6 AND 38.5 AND k % 40 + 66.25 BETWEEN 67 AND 98.5), points AS (SELECT agent, lat, lng, tower, count(*) AS n, max(ts) AS last_ts FROM pts GROUP BY ALL)"


@query("a20_location_points", POINTS + f"SELECT agent, lat::DOUBLE AS lat, lng::DOUBLE AS lng, tower, n, strftime(last_ts, {DUCK_ISO}) AS last_ts FROM points")
def a20(spark, d):
    return R.location_points(_located(spark, d)).withColumn("last_ts", iso("last_ts"))


@query("a21_agent_centroid", POINTS + ", c AS (SELECT * FROM (VALUES ('DL', 28.6139, 77.2090), ('KA', 15.3173, 75.7139), ('MH', 19.7515, 75.7139), ('UP', 26.8467, 80.9462), ('WB', 22.9868, 87.8550)) v(circle, x, y)), m AS (SELECT agent, quantile_cont(lat, 0.5) AS lat, quantile_cont(lng, 0.5) AS lng FROM pts GROUP BY 1) SELECT subscriber_id AS agent, round(coalesce(m.lat, c.x), 5)::DOUBLE AS lat, round(coalesce(m.lng, c.y), 5)::DOUBLE AS lng FROM subscribers s LEFT JOIN m ON m.agent = s.subscriber_id JOIN c USING (circle)")
def a21(spark, d):
    pts = R.location_points(_located(spark, d))
    return R.agent_centroid(pts, _agents(spark, d)).select("agent", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


STATS = ENDS + """, a AS (SELECT agent, count(*) FILTER (dir = 'outgoing') AS outgoing_calls, count(*) FILTER (dir = 'incoming') AS incoming_calls, sum(duration) AS call_seconds, count(DISTINCT other) AS contacts, count(DISTINCT other) FILTER (dir = 'outgoing') AS outgoing_contacts, count(DISTINCT other) FILTER (dir = 'incoming') AS incoming_contacts, count(DISTINCT ts::DATE) AS call_days, max(ts) AS lc FROM ends GROUP BY 1),
s AS (SELECT subscriber AS agent, count(*) AS sessions, sum(mb) AS mb, count(DISTINCT destination) AS destinations, count(DISTINCT port) AS ports, max(ts) AS ls FROM sessions GROUP BY 1),
e AS (SELECT agent, count(*) AS friends FROM (SELECT lo AS agent FROM observed UNION ALL SELECT hi FROM observed) GROUP BY 1)
"""


@query("a22_agent_stats", STATS + f"SELECT subscriber_id AS agent, coalesce(outgoing_calls, 0) AS outgoing_calls, coalesce(incoming_calls, 0) AS incoming_calls, round(coalesce(call_seconds, 0), 4) AS call_seconds, coalesce(contacts, 0) AS contacts, coalesce(outgoing_contacts, 0) AS outgoing_contacts, coalesce(incoming_contacts, 0) AS incoming_contacts, coalesce(call_days, 0) AS call_days, coalesce(sessions, 0) AS sessions, round(coalesce(mb, 0), 4) AS mb, coalesce(destinations, 0) AS destinations, coalesce(ports, 0) AS ports, coalesce(friends, 0) AS friends, coalesce(outgoing_calls, 0) + coalesce(incoming_calls, 0) AS calls, strftime(greatest(lc, ls), {DUCK_ISO}) AS last_activity FROM subscribers LEFT JOIN a ON a.agent = subscriber_id LEFT JOIN s ON s.agent = subscriber_id LEFT JOIN e ON e.agent = subscriber_id")
def a22(spark, d):
    s = R.agent_stats(V.calls(spark, d), V.sessions(spark, d), V.observed(spark, d), _agents(spark, d))
    return s.withColumns({"call_seconds": F.round("call_seconds", 4), "mb": F.round("mb", 4), "last_activity": iso("last_activity")})


@query("a23_hourly_histogram", ENDS + "SELECT agent, hour(ts)::INT AS hour, count(*) AS n FROM ends GROUP BY ALL UNION ALL SELECT '*', hour(ts)::INT, count(*) FROM ends GROUP BY ALL")
def a23(spark, d):
    return R.hourly_histogram(V.calls(spark, d))


@query("a24_dashboard_totals", "SELECT (SELECT count(*) FROM subscribers) AS agents, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM sessions) AS sessions, (SELECT round(sum(mb), 3) FROM sessions) AS mb, (SELECT count(*) FROM observed) AS edges, (SELECT count(*) FROM calls WHERE receiver IN (SELECT subscriber_id FROM subscribers)) AS incoming_core_calls")
def a24(spark, d):
    o = V.observed(spark, d)
    twice = o.unionByName(o.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    return R.dashboard_totals(V.calls(spark, d), V.sessions(spark, d), twice, _agents(spark, d)).withColumn("mb", F.round("mb", 3))


@query("a34_same_group_share", "SELECT count(*) AS calls, " + q6("avg((a.region = b.region)::INT)", "share") + " FROM calls JOIN subscribers a ON a.subscriber_id = caller JOIN subscribers b ON b.subscriber_id = receiver")
def a34(spark, d):
    return R.same_group_share(V.calls(spark, d), _agents(spark, d), "region").select("calls", r6(F.col("share"), "share"))


@query("a35_device_audit", "SELECT 'shared_device' AS finding, imei AS key, greatest(count(DISTINCT imsi), count(DISTINCT msisdn)) AS others FROM subscribers GROUP BY 2 HAVING greatest(count(DISTINCT imsi), count(DISTINCT msisdn)) > 1 UNION ALL SELECT 'sim_swap', imsi, count(DISTINCT imei) FROM subscribers GROUP BY 2 HAVING count(DISTINCT imei) > 1")
def a35(spark, d):
    return R.device_audit(V.subscribers(spark, d))


@query("a36_dataset_summary", "SELECT 'agents' AS metric, count(*) AS n FROM subscribers UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'edges', count(*) FROM observed")
def a36(spark, d):
    return R.dataset_summary(V.calls(spark, d), V.sessions(spark, d), V.observed(spark, d), _agents(spark, d))


@query("w5_top_values", ", c AS (SELECT subscriber, CASE WHEN port::INT % 10 = 0 THEN 'Unknown' ELSE port END AS value, count(*) AS n FROM sessions GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY n DESC, value)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def w5(spark, d):
    s = V.sessions(spark, d).withColumn("port", F.when(F.col("port").cast("int") % 10 == 0, "").otherwise(F.col("port")))
    return R.top_values(s, "subscriber", "port")


SCORED = ", oe AS (SELECT lo, hi, CASE WHEN (lo::BIGINT + hi::BIGINT) % 5 <> 0 THEN ((lo::BIGINT * 31 + hi::BIGINT * 17) % 1000) / 1000.0::DOUBLE END AS score FROM observed)"
LINES = ENDS + POINTS + SCORED + """, fe AS (SELECT lo AS agent, hi AS name, score FROM oe UNION ALL SELECT hi, lo, score FROM oe),
li AS (SELECT agent, 'contacts' AS part, -count(*)::DOUBLE AS o, other AS name, max(ts) AS ts, NULL AS direction, count(*)::DOUBLE AS measure, NULL::DOUBLE AS lat, NULL::DOUBLE AS lng, NULL AS detail, NULL AS port FROM ends GROUP BY agent, other
UNION ALL SELECT agent, 'friends', -coalesce(score, -1), name, NULL, NULL, score, NULL, NULL, NULL, NULL FROM fe
UNION ALL SELECT agent, 'locations', -n, tower, last_ts, NULL, n, lat, lng, NULL, NULL FROM points
UNION ALL SELECT agent, 'calls', -epoch_us(ts)::DOUBLE, other, ts, dir, duration, NULL, NULL, event_type, NULL FROM ends
UNION ALL SELECT subscriber, 'sessions', -epoch_us(ts)::DOUBLE, NULL, ts, NULL, mb, NULL, NULL, destination, port FROM sessions)
"""


def _documents(spark, d):
    total = F.col("lo").cast("long") + F.col("hi").cast("long")
    score = F.when(total % 5 != 0, (F.col("lo").cast("long") * 31 + F.col("hi").cast("long") * 17) % 1000 / 1000.0)
    agents = stored(_agents(spark, d), "agents")
    return V.calls(spark, d), V.sessions(spark, d), V.observed(spark, d).withColumn("score", score), R.location_points(_located(spark, d)), agents


# calls in order of duration before type, sessions of destination and port before volume, as the columns stand
PLACE = "row_number() OVER (PARTITION BY agent, part ORDER BY o, name, ts, direction, CASE WHEN part = 'calls' THEN measure END, lat, lng, detail, port, measure)"


@query("w9_agent_timelines", LINES + f"SELECT agent, part, {PLACE} AS k, name, strftime(ts, {DUCK_ISO}) AS ts, direction, round(measure, 4) AS measure, detail, port FROM li WHERE agent IN (SELECT subscriber_id FROM subscribers)")
def w9(spark, d):
    rows = R.agent_lines(*_documents(spark, d))
    measure = F.coalesce("score", (F.col("outgoing") + F.col("incoming")).cast("double"), F.col("n").cast("double"), "duration", "mb")
    return rows.select("agent", "part", "k", "name", iso("ts").alias("ts"), "direction", F.round(measure, 4).alias("measure"), F.coalesce("event_type", "destination").alias("detail"), "port")


_MEASURES = ["outgoing_calls", "incoming_calls", "contacts", "outgoing_contacts", "incoming_contacts", "call_days", "sessions", "destinations", "ports", "friends"]


@query("s10_agent_docs", STATS + LINES[len(ENDS):] + f"""SELECT agent, part, {PLACE} AS k, name, strftime(ts, {DUCK_ISO}) AS ts, direction, round(measure, 4) AS measure, round(lat, 5)::DOUBLE AS lat, round(lng, 5)::DOUBLE AS lng, detail, port FROM li WHERE agent IN (SELECT subscriber_id FROM subscribers)
UNION ALL SELECT subscriber_id, 'stats', 1, concat_ws(' ', {', '.join(f'coalesce({c}, 0)' for c in _MEASURES)}), strftime(greatest(lc, ls), {DUCK_ISO}), NULL, round(coalesce(call_seconds, 0), 4), NULL, NULL, round(coalesce(mb, 0), 2)::DECIMAL(18, 2)::VARCHAR, NULL FROM subscribers LEFT JOIN a ON a.agent = subscriber_id LEFT JOIN s ON s.agent = subscriber_id LEFT JOIN e ON e.agent = subscriber_id""")
def s10(spark, d):
    path, docs = _scratch(spark, "s10"), R.agent_documents(*_documents(spark, d))
    files.write_agent_docs(docs, path, dealt=True)
    i, s = F.col("item"), F.col("stats")
    measure = F.coalesce(i["score"], (i["outgoing"] + i["incoming"]).cast("double"), i["n"].cast("double"), i["duration"], i["mb"], s["call_seconds"])
    detail = F.coalesce(i["event_type"], i["destination"], F.round(s["mb"], 2).cast("decimal(18, 2)").cast("string"))
    return files.read_agent_docs(spark, path, docs.schema).select(
        F.col("agent_id").alias("agent"), "part", "k", F.when(s.isNotNull(), F.concat_ws(" ", *[s[c] for c in _MEASURES])).otherwise(i["name"]).alias("name"), iso(F.coalesce(i["ts"], s["last_activity"])).alias("ts"),
        i["direction"].alias("direction"), F.round(measure, 4).alias("measure"), F.round(i["lat"], 5).alias("lat"), F.round(i["lng"], 5).alias("lng"), detail.alias("detail"), i["port"].alias("port"),
    )


@query("w10_latest_activity", ENDS + f"SELECT agent, strftime(max(ts), {DUCK_ISO}) AS last_ts FROM (SELECT agent, ts FROM ends UNION ALL SELECT subscriber, ts FROM sessions) GROUP BY 1")
def w10(spark, d):
    return R.latest_activity(V.calls(spark, d), V.sessions(spark, d)).withColumn("last_ts", iso("last_ts"))


@query("j7_enrich_contacts", ", c AS (SELECT event_id, (receiver::BIGINT + 919000000000 + CASE WHEN k % 2 = 0 THEN 0 ELSE 5000000 END)::VARCHAR AS other_msisdn, CASE WHEN k % 5 = 0 THEN 'dummy_entity' END AS given FROM calls) SELECT event_id, other_msisdn, subscriber_id AS other_id, region AS other_region, CASE WHEN subscriber_id IS NOT NULL THEN 'core_agent' ELSE coalesce(given, 'external_contact') END AS kind FROM c LEFT JOIN subscribers ON msisdn = other_msisdn")
def j7(spark, d):
    k = F.col("k")
    c = V.calls(spark, d).select("event_id", (F.col("receiver").cast("long") + 919000000000 + F.when(k % 2 == 0, 0).otherwise(5000000)).cast("string").alias("other_msisdn"), F.when(k % 5 == 0, "dummy_entity").alias("given_kind"))
    return R.enrich_contacts(c, V.subscribers(spark, d)).select("event_id", "other_msisdn", "other_id", "other_region", "kind")
