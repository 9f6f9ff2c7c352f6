"""Canonical telecom views derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """subscriber, ts, destination, port, cell, mb, session_s, event_id."""
    return _events(spark, d).select(
        "event_id", F.col("user_id").cast("string").alias("subscriber"), "ts", F.concat_ws(":", "event_type", (F.col("k") % 20).cast("string")).alias("destination"),
        F.col("k").cast("string").alias("port"), (F.col("user_id") % 7).cast("string").alias("cell"), F.col("value").alias("mb"), ((F.col("k") + 1) * 10).cast("double").alias("session_s"),
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """caller, receiver, ts, duration, event_type, event_id."""
    u, k = F.col("user_id"), F.col("k")
    return _events(spark, d).select(
        "event_id", u.cast("string").alias("caller"), (F.floor(u / 10) * 10 + (u % 10 + 1 + k % 9) % 10).cast("string").alias("receiver"), "ts", F.col("value").alias("duration"),
        F.when(k % 3 == 0, "VOICE").when(k % 3 == 1, "SMS").otherwise("data call").alias("event_type"), "k",
    )


def subscribers(spark: SparkSession, d: str) -> DataFrame:
    """subscriber_id, msisdn, imei, imsi, circle, tower, region, lat, lng."""
    u = F.col("user_id")
    people = table(spark, d, "events").select("user_id").distinct()
    region = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("region"))
    place = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "region")
    circle = F.element_at(F.array(*[F.lit(x) for x in ("MH", "DL", "KA", "UP", "WB")]), (u % 5 + 1).cast("int"))
    return people.join(place, u == F.col("c_custkey"), "left").select(
        u.cast("string").alias("subscriber_id"), (u + 919000000000).cast("string").alias("msisdn"), F.concat(F.lit("IMEI"), F.floor(u / 2).cast("string")).alias("imei"),
        F.concat(F.lit("IMSI"), (u % 400).cast("string")).alias("imsi"), circle.alias("circle"), F.concat(F.lit("T"), (u % 500 + 1000).cast("string")).alias("tower"), F.coalesce("region", F.lit("unknown")).alias("region"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """lo, hi, label: the distinct unordered pairs of calls."""
    c = calls(spark, d)
    p = c.select(F.least("caller", "receiver").alias("lo"), F.greatest("caller", "receiver").alias("hi")).distinct()
    return p.withColumn("label", ((F.col("lo").cast("long") + F.col("hi").cast("long")) % 2).cast("int"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    """lo, hi: edges seen in the data."""
    return pairs(spark, d).where((F.col("lo").cast("long") + F.col("hi").cast("long")) % 3 != 0).select("lo", "hi")


def inferred(spark: SparkSession, d: str) -> DataFrame:
    """lo, hi, score: edges that a model proposes."""
    lo, hi = F.col("lo").cast("long"), F.col("hi").cast("long")
    return pairs(spark, d).where((lo + hi) % 4 != 1).select("lo", "hi", ((lo * 31 + hi * 17) % 1000 / 1000.0).alias("score"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """id, label, p, source, person_a, person_b, ts: scored rows with a known label."""
    source = F.element_at(F.array(*[F.lit(x) for x in ("observed", "confirmed", "inferred", "sampled_negative")]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"), source.alias("source"), F.col("n_chars"))


def messy(spark: SparkSession, d: str) -> DataFrame:
    """id, raw: identifiers in many spellings, and missing ones."""
    k = F.col("c_custkey")
    n = (k % 300 + 9000000000).cast("string")
    raw = (
        F.when(k % 8 == 0, F.concat(F.lit("+91 ("), F.substring(n, 1, 5), F.lit(") "), F.substring(n, 6, 5)))
        .when(k % 8 == 1, F.concat(F.lit('="'), n, F.lit('"')))
        .when(k % 8 == 2, F.concat(F.lit("0"), n))
        .when(k % 8 == 3, F.concat(F.lit("0091"), n))
        .when(k % 8 == 4, F.concat(n, F.lit(".00")))
        .when(k % 40 == 5, "\tNaN \t")
        .when(k % 8 == 5, "NaN")
        .when(k % 40 == 7, F.concat(F.lit("　"), F.translate(n, "0123456789", "０１２３４５６７８９"), F.lit("\t")))
        .when(k % 40 == 14, F.concat(F.lit(" \ufb01rst Cafe\u0301 \u00bd Stra\u00dfe "), k.cast("string")))
        .when(k % 8 == 6, F.concat(F.lit("  "), F.col("c_name"), F.lit("   X ")))
        .otherwise(n)
    )
    return table(spark, d, "customer").select(k.alias("id"), raw.alias("raw"), "c_name", "c_acctbal", "c_mktsegment")


SQL = """WITH ev AS (SELECT event_id, ts, user_id AS u, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
sessions AS (SELECT event_id, u::VARCHAR AS subscriber, ts, event_type || ':' || (k % 20) AS destination, k::VARCHAR AS port, (u % 7)::VARCHAR AS cell, value AS mb, ((k + 1) * 10)::DOUBLE AS session_s FROM ev),
calls AS (SELECT event_id, u::VARCHAR AS caller, ((u // 10) * 10 + (u % 10 + 1 + k % 9) % 10)::VARCHAR AS receiver, ts, value AS duration,
  CASE k % 3 WHEN 0 THEN 'VOICE' WHEN 1 THEN 'SMS' ELSE 'data call' END AS event_type, k FROM ev),
places AS (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
subscribers AS (SELECT u::VARCHAR AS subscriber_id, (u + 919000000000)::VARCHAR AS msisdn, 'IMEI' || (u // 2) AS imei, 'IMSI' || (u % 400) AS imsi, ['MH','DL','KA','UP','WB'][u % 5 + 1] AS circle,
  'T' || (u % 500 + 1000) AS tower, coalesce(r_name, 'unknown') AS region FROM (SELECT DISTINCT u FROM ev) LEFT JOIN places ON u = c_custkey),
pairs AS (SELECT lo, hi, ((lo::BIGINT + hi::BIGINT) % 2)::INT AS label FROM (SELECT DISTINCT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi FROM calls)),
observed AS (SELECT lo, hi FROM pairs WHERE (lo::BIGINT + hi::BIGINT) % 3 <> 0),
inferred AS (SELECT lo, hi, ((lo::BIGINT * 31 + hi::BIGINT * 17) % 1000) / 1000.0::DOUBLE AS score FROM pairs WHERE (lo::BIGINT + hi::BIGINT) % 4 <> 1),
scores AS (SELECT l.doc_id AS id, l.quality::INT AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS p, ['observed','confirmed','inferred','sampled_negative'][l.doc_id % 4 + 1] AS source, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
messy AS (SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment, CASE c_custkey % 8 WHEN 0 THEN '+91 (' || substr(n, 1, 5) || ') ' || substr(n, 6, 5) WHEN 1 THEN '="' || n || '"' WHEN 2 THEN '0' || n WHEN 3 THEN '0091' || n
  WHEN 4 THEN n || '.00' WHEN 5 THEN CASE WHEN c_custkey % 40 = 5 THEN E'\\tNaN \\t' ELSE 'NaN' END WHEN 7 THEN CASE WHEN c_custkey % 40 = 7 THEN '　' || translate(n, '0123456789', '０１２３４５６７８９') || E'\\t' ELSE n END WHEN 6 THEN CASE WHEN c_custkey % 40 = 14 THEN ' ﬁrst Café ½ Straße ' || c_custkey ELSE '  ' || c_name || '   X ' END ELSE n END AS raw FROM (SELECT *, (c_custkey % 300 + 9000000000)::VARCHAR AS n FROM customer))
"""
