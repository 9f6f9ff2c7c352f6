"""Queries: streaming twins, run over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringdata.plans.q_basic import DUCK_ISO, iso
from ringdata.plans.registry import query
from ringdata.sources import views as V
from ringdata.streaming import incremental as T


def _stream(spark, d):
    s = T.read_stream(spark, d, V.table(spark, d, "events").schema, "events.parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("subscriber"), "event_type", F.col("value").alias("mb"))


@query("t1_stream_filter_junk", "SELECT event_id, subscriber::VARCHAR AS subscriber, event_type FROM (SELECT event_id, u AS subscriber, event_type FROM ev) WHERE NOT regexp_matches(event_type, '(?i)error|spam')")
def t1(spark, d):
    return T.run_to_table(T.stream_filter_junk(_stream(spark, d).select("event_id", "subscriber", "event_type"), ["subscriber"], ["error", "spam"]), "t1")


@query("t2_stream_hourly_sessions", f", h AS (SELECT subscriber, date_trunc('hour', ts) AS hour, count(*) AS sessions, round(sum(mb), 4) AS mb FROM sessions GROUP BY ALL) SELECT subscriber, strftime(hour, {DUCK_ISO}) AS hour, sessions, mb FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM sessions)")
def t2(spark, d):
    out = T.run_to_table(T.stream_hourly_sessions(_stream(spark, d)), "t2")
    return out.select("subscriber", iso("hour").alias("hour"), "sessions", F.round("mb", 4).alias("mb"))


@query("t3_stream_subject_activity", f"SELECT caller AS subject, count(*) AS rows, strftime(min(ts), {DUCK_ISO}) AS first_ts, strftime(max(ts), {DUCK_ISO}) AS last_ts FROM calls GROUP BY 1")
def t3(spark, d):
    s = T.stream_subject_activity(_stream(spark, d), "subscriber")
    return s.select("subject", "rows", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"))
