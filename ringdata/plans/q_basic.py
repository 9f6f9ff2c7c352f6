"""Queries: sources, scalars, filters, identity and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.operators import evidence as E
from ringdata.operators import filters as P
from ringdata.operators import identity as J
from ringdata.operators.schema import canonicalize_source
from ringdata.operators.times import parse_event_times
from ringdata.plans.registry import query
from ringdata.sources import files
from ringdata.sources import views as V
from ringdata.sources.tables import shared_dir

ISO = "yyyy-MM-dd HH:mm:ss"


def iso(c):
    return F.date_format(c, ISO)


DUCK_ISO = "'%Y-%m-%d %H:%M:%S'"
_T = "trim(translate(nfc_normalize(replace(replace(raw, 'ﬁ', 'fi'), '½', '1⁄2')), '０１２３４５６７８９　', '0123456789 '), E' \\t\\n')"
CLEAN = f"trim(CASE WHEN {_T} LIKE '=\"%\"' THEN replace({_T}[3:-2], '\"\"', '\"') ELSE {_T} END, E' \\t\\n')"
DIGITS = "regexp_replace(t2, '[^0-9]', '', 'g')"
#: normalized identifier of column raw in relation rel, by the general and by the phone rule
NORM = """, n1 AS (SELECT *, {clean} AS t1 FROM {rel}), n2 AS (SELECT *, regexp_replace(t1, '^([0-9]+)\\.0+$', '\\1') AS t2 FROM n1),
n3 AS (SELECT *, {digits} AS d0, replace(lower(trim(regexp_replace(t2, '\\s+', ' ', 'g'))), 'ß', 'ss') AS g FROM n2),
n4 AS (SELECT *, CASE WHEN starts_with(d0, '00') THEN substr(d0, 3) ELSE d0 END AS d FROM n3),
norm AS (SELECT *, CASE WHEN lower(t1) IN ('', 'nan', 'none', 'null', 'nat', '<na>') THEN '' ELSE g END AS plain,
  CASE WHEN lower(t1) IN ('', 'nan', 'none', 'null', 'nat', '<na>') THEN '' WHEN regexp_full_match(t2, '[+()\\-\\s.0-9]+') AND length(d0) >= 7
    THEN CASE WHEN length(d) = 10 THEN '91' || d WHEN length(d) = 11 AND starts_with(d, '0') THEN '91' || substr(d, 2) ELSE d END ELSE g END AS phone FROM n4)
"""


def norm_sql(rel: str) -> str:
    return NORM.format(clean=CLEAN, digits=DIGITS, rel=rel)


# ---- scalars


@query("f1_clean_text", f"SELECT id, {CLEAN} AS cleaned FROM messy")
def f1(spark, d):
    return V.messy(spark, d).select("id", S.clean_text(F.col("raw")).alias("cleaned"))


@query("f2_is_missing_text", "SELECT lower(trim(raw, E' \\t\\n')) IN ('', 'nan', 'none', 'null', 'nat', '<na>') AS missing, count(*) AS n FROM messy GROUP BY 1")
def f2(spark, d):
    return V.messy(spark, d).groupBy(S.is_missing_text(F.col("raw")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("f3_normalize_identifier", norm_sql("messy") + "SELECT id, plain, phone FROM norm")
def f3(spark, d):
    return V.messy(spark, d).select("id", S.normalize_identifier(F.col("raw")).alias("plain"), S.normalize_identifier(F.col("raw"), phone=True).alias("phone"))


@query("f4_identifier_variants", norm_sql("messy") + "SELECT id, CASE WHEN phone = '' THEN '' WHEN phone = plain THEN phone ELSE phone || '|' || plain END AS variants FROM norm")
def f4(spark, d):
    return V.messy(spark, d).select("id", F.array_join(S.identifier_variants(F.col("raw"), True), "|").alias("variants"))


# two sources: in that of even numbers most dates start with the year (so that 01/02/2024 is a second of January), in the other with the day
TIMES = """, tt AS (SELECT event_id, ts, event_id % 2 AS source, CASE event_id % 10 WHEN 0 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
  WHEN 5 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 7 THEN strftime(ts, '%d/%m/%Y') WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 8 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE 'soon' END AS raw,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'UTC' ELSE '+03:00' END AS zone FROM ev)
"""


def _times(spark, d):
    e, ts = V.calls(spark, d), F.col("ts")
    k = F.col("event_id") % 10
    shown = lambda form: F.date_format(ts, form)
    raw = (
        F.when(k == 0, shown("MM/dd/yyyy HH:mm:ss")).when(k.isin(1, 6), F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(k == 2, shown("yyyy-MM-dd"))
        .when(k.isin(3, 5), shown("dd/MM/yyyy HH:mm:ss")).when(k == 7, shown("dd/MM/yyyy")).when(k == 8, shown("yyyy/MM/dd HH:mm:ss")).otherwise("soon")
    )
    z = F.col("event_id") % 3
    return e.select("event_id", (F.col("event_id") % 2).alias("source"), raw.alias("raw"), F.when(z == 0, "").when(z == 1, "UTC").otherwise("+03:00").alias("zone"))


@query(
    "f5_parse_event_time",
    TIMES
    + f""", off AS (SELECT *, CASE WHEN zone = '' THEN 19800 WHEN zone = 'UTC' THEN 0 ELSE 10800 END AS o FROM tt)
SELECT event_id, CASE WHEN event_id % 10 IN (4, 9) THEN NULL WHEN event_id % 10 IN (1, 6) THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, {DUCK_ISO}) WHEN event_id % 10 IN (2, 7) THEN strftime(date_trunc('day', ts) - to_seconds(o), {DUCK_ISO}) ELSE strftime(date_trunc('second', ts) - to_seconds(o), {DUCK_ISO}) END AS utc,
CASE WHEN event_id % 10 IN (4, 9) THEN 'invalid' WHEN event_id % 10 IN (1, 6) THEN 'explicit' WHEN zone = '' THEN 'assumed' ELSE 'zone' END AS status FROM off""",
)
def f5(spark, d):
    parsed = parse_event_times(_times(spark, d), "raw", F.col("zone"), ["source"])
    return parsed.select("event_id", iso("event.instant").alias("utc"), "event.status")


@query("f6_parse_timezone", TIMES + "SELECT zone, CASE WHEN zone = '' THEN '' ELSE zone END AS parsed, count(*) AS n FROM tt GROUP BY ALL")
def f6(spark, d):
    return _times(spark, d).groupBy("zone", S.valid_zone(F.col("zone")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


@query("f7_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM ev")
def f7(spark, d):
    return V.calls(spark, d).select("event_id", S.iso_utc(F.col("ts")).alias("iso"))


@query("f8_time_flags", "SELECT event_id, hour(ts)::INT AS hour, hour(ts) < 6 OR hour(ts) >= 22 AS night, isodow(ts) >= 6 AS weekend, strftime(ts, '%Y-%m-%d') AS day FROM ev")
def f8(spark, d):
    t = F.col("ts")
    return V.calls(spark, d).select("event_id", S.hour_of(t).alias("hour"), S.is_night(t).alias("night"), S.is_weekend(t).alias("weekend"), S.event_day(t).cast("string").alias("day"))


@query("f9_hour_bucket", f"SELECT strftime(date_trunc('hour', ts), {DUCK_ISO}) AS bucket, count(*) AS n FROM ev GROUP BY 1")
def f9(spark, d):
    return V.calls(spark, d).groupBy(iso(S.hour_bucket(F.col("ts"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f10_canonical_pair", "SELECT least(caller, receiver) AS lo, greatest(caller, receiver) AS hi, count(*) AS n FROM calls GROUP BY ALL")
def f10(spark, d):
    lo, hi = S.canonical_pair(F.col("caller"), F.col("receiver"))
    return V.calls(spark, d).groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_parse_label", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN label = 1 THEN 1 ELSE 0 END::INT AS parsed FROM scores")
def f11(spark, d):
    text = F.when(F.col("id") % 3 == 0, "maybe").when(F.col("label") == 1, F.when(F.col("id") % 2 == 0, " Friend").otherwise("YES")).otherwise("not_friend")
    return V.scores(spark, d).select("id", S.parse_label(text).alias("parsed"))


SETS = """, ab AS (SELECT s.c_custkey AS id, list_distinct([s.c_custkey % 5, s.c_custkey % 7, s.c_custkey % 3]) AS a, list_distinct([s.c_custkey % 4, s.c_custkey % 6]) AS b FROM customer s)"""


def _sets(spark, d):
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(k.alias("id"), F.array_distinct(F.array(k % 5, k % 7, k % 3)).alias("a"), F.array_distinct(F.array(k % 4, k % 6)).alias("b"))


@query("f12_jaccard", SETS + "SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS j FROM ab")
def f12(spark, d):
    return _sets(spark, d).select("id", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query(
    "f13_cosine",
    """, q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id < 40)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.e::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.e::DOUBLE[], b.e::DOUBLE[]))), 5) AS c
FROM embeddings a JOIN q b ON b.vec_id = a.vec_id % 40""",
)
def f13(spark, d):
    # every vector against a stated reference vector, an equi-join
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    ref = e.where("a < 40").select(F.col("a").alias("b"), F.col("x").alias("y"))
    return e.join(ref, F.col("a") % 40 == F.col("b")).select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 5).alias("c"))


@query("f14_ratio_similarity", "SELECT event_id, round(CASE WHEN greatest(mb, session_s) > 0 THEN least(mb, session_s) / greatest(mb, session_s) ELSE 0 END + 1e-9, 6) AS r FROM sessions")
def f14(spark, d):
    return V.sessions(spark, d).select("event_id", F.round(S.ratio_similarity(F.col("mb"), F.col("session_s")) + 1e-9, 6).alias("r"))


# every spelling of V.messy, and some that are numbers to one reader and not to another
_NUMBERS = ["' ' || raw || E'\\n'", "raw || 'd'", "'7f'", "'0x1p3'", "raw || 'e-2'", "'1_0' || raw", "'1__0'", "'-.5E+1'", "'+' || raw", "'1e999'", "'٣' || raw", "raw"]


@query(
    "f15_safe_number",
    f""", spelt AS (SELECT id, CASE id % 12 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_NUMBERS))} END AS raw FROM messy),
read AS (SELECT id, raw, trim(translate(raw, '０１２３４５６７８９٣', '01234567893'), E' \t\n　') AS t FROM spelt)
SELECT id, raw, coalesce(CASE WHEN regexp_matches(t, '^[+-]?([0-9](_?[0-9])*([.]([0-9](_?[0-9])*)?)?|[.][0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$') AND NOT isinf(coalesce(TRY_CAST(replace(t, '_', '') AS DOUBLE), 'inf'::DOUBLE)) THEN TRY_CAST(replace(t, '_', '') AS DOUBLE) END, -1.0) AS x FROM read""",
)
def f15(spark, d):
    spelt = F.expr("CASE pmod(id, 12) " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_NUMBERS)).replace("E'\\n'", "'\\n'") + " END")
    return V.messy(spark, d).select("id", spelt.alias("raw")).withColumn("x", S.safe_number(F.col("raw"), -1.0))


@query("f16_megabytes", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN mb WHEN event_id % 3 = 1 THEN (mb * 3) / 1024 ELSE 0 END + 1e-9, 6) AS x FROM sessions")
def f16(spark, d):
    k, mb = F.col("event_id") % 3, F.col("mb")
    return V.sessions(spark, d).select("event_id", F.round(S.megabytes(F.when(k == 0, mb), F.when(k == 1, mb), F.when(k == 1, mb * 2)) + 1e-9, 6).alias("x"))


@query("f17_is_voice", "SELECT event_type, lower(event_type) LIKE '%voice%' OR lower(event_type) LIKE '%call%' AS voice, count(*) AS n FROM calls GROUP BY ALL")
def f17(spark, d):
    return V.calls(spark, d).groupBy("event_type", S.is_voice(F.col("event_type")).alias("voice")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_valid_coordinate", "SELECT event_id, (k / 2.0 BETWEEN 6 AND 38.5) AND (value + 60 BETWEEN 67 AND 98.5) AS ok FROM ev")
def f18(spark, d):
    return V.calls(spark, d).select("event_id", S.valid_coordinate(F.col("k") / 2.0, F.col("duration") + 60).alias("ok"))


@query("f19_stable_numeric_id", "SELECT subscriber_id, lpad((('0x' || substr(sha256(tower), 1, 16))::UBIGINT % 1000000000000000)::VARCHAR, 15, '0') AS cell FROM subscribers")
def f19(spark, d):
    return V.subscribers(spark, d).select("subscriber_id", S.stable_numeric_id(F.col("tower")).alias("cell"))


@query("f20_valid_port", "SELECT event_id, CASE WHEN port::INT BETWEEN 1 AND 65535 THEN port::INT END AS p FROM sessions")
def f20(spark, d):
    return V.sessions(spark, d).select("event_id", S.valid_port(F.col("port")).alias("p"))


@query("f21_log1p_clip", "SELECT event_id, round(ln(1 + greatest(mb - 5, 0)), 6) AS x FROM sessions")
def f21(spark, d):
    return V.sessions(spark, d).select("event_id", F.round(S.log1p_clip(F.col("mb") - 5), 6).alias("x"))


@query("f22_prediction_text", "SELECT id, CASE WHEN p >= 0.5 THEN 'Friend / interacting' ELSE 'Not friend / not interacting' END AS t FROM scores")
def f22(spark, d):
    return V.scores(spark, d).select("id", S.prediction_text(F.col("p"), 0.5).alias("t"))


@query("f23_hour_from_text", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE hour(ts)::INT END AS h FROM ev")
def f23(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(iso("ts"))
    return V.calls(spark, d).select("event_id", S.hour_from_text(text).alias("h"))


# ---- filters


@query("p1_filter_junk", "SELECT id, raw, c_name FROM messy WHERE NOT regexp_matches(raw, '[A-Za-z]') AND NOT regexp_matches(c_name || ' ' || raw || ' ' || c_mktsegment, '(?i)house|spam')")
def p1(spark, d):
    return P.filter_junk(V.messy(spark, d).select("id", "raw", "c_name", "c_mktsegment"), ["raw"], ["house", "spam"]).select("id", "raw", "c_name")


@query(
    "p2_junk_reasons",
    ", m AS (SELECT regexp_matches(raw, '[A-Za-z]') AS l, regexp_matches(c_mktsegment, '(?i)house|spam') AS w FROM messy) SELECT count(*) AS rows_read, count(*) FILTER (NOT l AND NOT w) AS rows_kept, count(*) FILTER (l OR w) AS rows_removed, count(*) FILTER (l) AS letter_rows, count(*) FILTER (w) AS keyword_rows FROM m",
)
def p2(spark, d):
    return P.junk_reasons(V.messy(spark, d).select("raw", "c_mktsegment"), ["raw"], ["house", "spam"])


@query("p3_relevant_events", ", p AS (SELECT subscriber_id FROM subscribers WHERE region = 'ASIA') SELECT event_id, caller, receiver FROM calls WHERE caller IN (FROM p) OR receiver IN (FROM p)")
def p3(spark, d):
    people = V.subscribers(spark, d).where("region = 'ASIA'").select(F.col("subscriber_id").alias("person"))
    return P.relevant_events(V.calls(spark, d).select("event_id", "caller", "receiver"), people, ["caller", "receiver"])


@query("p4_usable_calls", ", c AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE caller END AS caller, CASE WHEN event_id % 7 = 0 THEN caller ELSE receiver END AS receiver FROM calls) SELECT * FROM c WHERE trim(caller) <> '' AND caller <> receiver")
def p4(spark, d):
    c = V.calls(spark, d).select("event_id", F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("caller")).alias("caller"), F.when(F.col("event_id") % 7 == 0, F.col("caller")).otherwise(F.col("receiver")).alias("receiver"))
    return P.usable_calls(c)


@query("p5_usable_measures", "SELECT event_id, mb - 5 AS mb, session_s - 100 AS s FROM sessions WHERE session_s - 100 >= 0 AND mb - 5 > 0 AND destination <> ''")
def p5(spark, d):
    s = V.sessions(spark, d).select("event_id", (F.col("mb") - 5).alias("mb"), (F.col("session_s") - 100).alias("s"), "destination")
    return P.usable_measures(s, "s", "mb", "destination").drop("destination")


@query("p6_search", "SELECT id, c_name, c_mktsegment FROM messy WHERE contains(lower(c_name || ' ' || c_mktsegment), '7 build')")
def p6(spark, d):
    return P.search(V.messy(spark, d).select("id", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "7 BUILD")


CONTACTS = ", ct AS (SELECT agent, other, count(*) FILTER (dir = 'out') AS outgoing, count(*) FILTER (dir = 'in') AS incoming FROM (SELECT caller AS agent, receiver AS other, 'out' AS dir FROM calls UNION ALL SELECT receiver, caller, 'in' FROM calls) GROUP BY ALL)"


@query("p7_contacts_by_direction", CONTACTS + "SELECT * FROM ct WHERE outgoing > 0 AND incoming > 0")
def p7(spark, d):
    from ringdata.operators.reports import contact_summary

    return P.contacts_by_direction(contact_summary(V.calls(spark, d)), "both").select("agent", "other", "outgoing", "incoming")


@query(
    "p8_calls_by_direction",
    f"SELECT event_id, direction, other, strftime(ts, {DUCK_ISO}) AS at FROM (SELECT event_id, ts, 'outgoing' AS direction, receiver AS other FROM calls WHERE caller = '3' UNION ALL SELECT event_id, ts, 'incoming', caller FROM calls WHERE receiver = '3')",
)
def p8(spark, d):
    return P.calls_by_direction(V.calls(spark, d), "3").select("event_id", "direction", "other", iso("ts").alias("at"))


# ---- sources


def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s1_csv_scan",
    f"""SELECT caller AS caller_id, receiver AS receiver_id, strftime(ts, {DUCK_ISO}) AS timestamp, NULL AS Call_Duration, NULL AS source FROM calls WHERE event_id % 2 = 0
UNION ALL SELECT caller, receiver, strftime(ts, {DUCK_ISO}), k::VARCHAR, event_type || ', ' || k FROM calls WHERE event_id % 2 = 1
UNION ALL SELECT 'Report', '', '', NULL, NULL FROM calls WHERE k = 7 AND event_id % 2 = 0 UNION ALL SELECT 'caller_id', 'receiver_id', 'timestamp', NULL, NULL FROM calls WHERE k = 8 AND event_id % 2 = 0""",
)
def s1(spark, d):
    path = _scratch(spark, "s1")
    # two layouts: some files have two rows before their header (it and one of them come again as data), the others none, more columns, in another order
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = V.calls(spark, d).withColumn("p", (F.col("event_id") % (2 * n)).cast("int"))
    first = F.when(F.col("id") % 2 == 0, "Report,,\nof all calls,,\ncaller_id,receiver_id,timestamp").otherwise("Call_Duration,caller_id,timestamp,source,receiver_id")
    head = spark.range(2 * n).select(F.col("id").cast("int").alias("p"), F.lit(-1).cast("long").alias("at"), first.alias("value"))
    even = F.concat_ws(",", "caller", "receiver", iso("ts"))
    odd = F.concat_ws(",", F.col("k").cast("string"), "caller", iso("ts"), F.concat(F.lit('"'), "event_type", F.lit(", "), F.col("k").cast("string"), F.lit('"')), "receiver")
    rows = c.select("p", F.col("event_id").alias("at"), F.when(F.col("p") % 2 == 0, even).otherwise(odd).alias("value"))
    again = c.where("k IN (7, 8) AND p % 2 = 0").select("p", F.col("event_id").alias("at"), F.when(F.col("k") == 7, "Report,,").otherwise("caller_id,receiver_id,timestamp").alias("value"))
    head.unionByName(rows).unionByName(again).repartitionById(2 * n, F.col("p")).sortWithinPartitions("at").select("value").write.text(path)
    found = files.read_records(spark, path)
    return found.select("caller_id", "receiver_id", "timestamp", "Call_Duration", "source")


@query("s2_canonical_select", f"SELECT caller, receiver, duration::VARCHAR AS duration, strftime(ts, {DUCK_ISO}) AS \"when\" FROM calls WHERE k >= 0")
def s2(spark, d):
    raw = V.calls(spark, d).select(F.col("caller").alias("Mobile_No"), F.col("receiver").alias("Other Party No"), F.col("duration").cast("string").alias("Call_Duration"), iso("ts").alias("timestamp"), "k")
    return canonicalize_source(raw, "cdr")


@query("c1_canonical_projection", f"SELECT subscriber, destination, port, strftime(ts, '%d/%m/%Y') || ' ' || strftime(ts, '%H:%M:%S') AS \"when\" FROM sessions")
def c1(spark, d):
    raw = V.sessions(spark, d).select(
        F.col("subscriber").alias("user_id"), F.col("destination").alias("Destination IP Address"), F.col("port").alias("destinationport"), F.date_format("ts", "dd/MM/yyyy").alias("start_date"), F.date_format("ts", "HH:mm:ss").alias("start_time"), "mb"
    )
    return canonicalize_source(raw, "ipdr")


@query("s3_malformed_rows", "SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS malformed FROM calls")
def s3(spark, d):
    path = _scratch(spark, "s3")
    line = F.concat_ws(",", "caller", "receiver", F.when(F.col("event_id") % 50 == 0, "x,y").otherwise("x"))
    V.calls(spark, d).select(line).write.text(path)
    df = spark.read.csv(path, schema="a string, b string, c string, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return files.malformed_rows(df)


@query("s4_alias_map_from_table", ", s AS (SELECT CASE WHEN subscriber_id LIKE '%7' THEN '' ELSE subscriber_id END AS i, CASE WHEN subscriber_id LIKE '%7' THEN msisdn ELSE subscriber_id END AS c, msisdn, imsi FROM subscribers), a AS (SELECT i AS alias, c FROM s WHERE i <> '' UNION SELECT msisdn, c FROM s UNION SELECT lower(imsi), c FROM s) SELECT alias, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS canonical, count(DISTINCT c) > 1 AS ambiguous FROM a GROUP BY 1")
def s4(spark, d):
    blank = F.when(F.col("subscriber_id").like("%7"), " \t").otherwise(F.col("subscriber_id"))  # these rows fall back on their msisdn
    return J.alias_map_from_table(V.subscribers(spark, d).select(blank.alias("subscriber_id"), "msisdn", "imsi", "region"))


@query("s5_alias_map_from_json", "SELECT lower(imei) AS alias, CASE WHEN count(DISTINCT subscriber_id) = 1 THEN min(subscriber_id) END AS canonical, count(DISTINCT subscriber_id) > 1 AS ambiguous FROM subscribers GROUP BY 1")
def s5(spark, d):
    path = _scratch(spark, "s5")
    rows = V.subscribers(spark, d).select(F.to_json(F.array(F.struct(F.col("imei").alias("alias"), F.col("subscriber_id").alias("canonical")))))
    rows.write.text(path)  # many small lists, one a file line; each is a whole text of its own
    lines = spark.read.text(path).select(F.inline(F.from_json("value", "array<struct<alias:string,canonical:string>>")))
    return J.finalize_map(lines.select(S.normalize_identifier(F.col("alias")).alias("alias"), S.normalize_identifier(F.col("canonical")).alias("canonical")))


MAPS = ", ma AS (SELECT imei AS alias, CASE WHEN count(*) = 1 THEN min(subscriber_id) END AS canonical, count(*) > 1 AS amb FROM subscribers GROUP BY 1), mb AS (SELECT imsi AS alias, min(subscriber_id) AS canonical, false AS amb FROM subscribers GROUP BY 1 UNION ALL SELECT imei, max(subscriber_id), false FROM subscribers WHERE subscriber_id LIKE '%5' GROUP BY 1)"


@query("s6_merge_alias_maps", MAPS + ", u AS (SELECT alias, bool_or(amb) OR count(DISTINCT canonical) > 1 AS ambiguous, min(canonical) AS c FROM (FROM ma UNION ALL FROM mb) GROUP BY 1) SELECT alias, CASE WHEN NOT ambiguous THEN c END AS canonical, ambiguous FROM u")
def s6(spark, d):
    s = V.subscribers(spark, d)
    a = J.finalize_map(s.select(F.col("imei").alias("alias"), F.col("subscriber_id").alias("canonical")))
    b = s.groupBy(F.col("imsi").alias("alias")).agg(F.min("subscriber_id").alias("canonical")).unionByName(s.where("subscriber_id LIKE '%5'").groupBy(F.col("imei").alias("alias")).agg(F.max("subscriber_id").alias("canonical")))
    return J.merge_alias_maps(a, b.withColumn("ambiguous", F.lit(False)))


@query("s7_read_pairs", "SELECT lo AS person_a, hi AS person_b, label, NULL::BIGINT AS source_row FROM pairs")
def s7(spark, d):
    p = V.pairs(spark, d)
    return J.read_pairs(p.select(F.col("lo").alias("user_a"), F.col("hi").alias("user_b"), F.when(F.col("label") == 1, "friend").otherwise("stranger").alias("is_friend")), require_label=True)


@query("s8_subscriber_aliases", ", a AS (SELECT unnest([subscriber_id, msisdn, lower(imei), lower(imsi)]) AS alias, subscriber_id AS c FROM subscribers) SELECT alias, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS canonical, count(DISTINCT c) > 1 AS ambiguous FROM a GROUP BY 1")
def s8(spark, d):
    return J.subscriber_aliases(V.subscribers(spark, d))


@query("s9_write_csv", "SELECT id, raw, c_name FROM messy")
def s9(spark, d):
    path = _scratch(spark, "s9")
    files.write_csv(V.messy(spark, d).select("id", "raw", "c_name"), path)
    return spark.read.csv(path, header=True, schema="id long, raw string, c_name string", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def digest_sql(*columns: str) -> str:
    """S11's digest of text columns, for DuckDB."""
    row = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"coalesce(sum(('0x' || substr(md5({row}), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR"


S11 = ", t AS (SELECT event_id::VARCHAR AS e, caller, receiver, strftime(ts, " + DUCK_ISO + ") AS moment, event_type, CASE WHEN k % 3 > 0 THEN k::VARCHAR END AS k FROM calls)"


@query("s11_fingerprint", S11 + f"SELECT count(*) AS rows, {digest_sql('e', 'caller', 'receiver', 'moment', 'event_type', 'k')} AS digest FROM t")
def s11(spark, d):
    return E.content_fingerprint(V.calls(spark, d).select("event_id", "caller", "receiver", iso("ts").alias("moment"), "event_type", F.when(F.col("k") % 3 > 0, F.col("k")).alias("k")))


@query("s12_union_sources", "SELECT source, count(*) AS n, count(mb) AS with_mb FROM (SELECT 'calls' AS source, NULL::DOUBLE AS mb FROM calls UNION ALL SELECT 'sessions', mb FROM sessions) GROUP BY 1")
def s12(spark, d):
    both = files.union_sources({"calls": V.calls(spark, d), "sessions": V.sessions(spark, d)})
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("mb").alias("with_mb"))


# ---- identity and evidence

AMAP = ", amap AS (SELECT alias, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS canonical, count(DISTINCT c) > 1 AS ambiguous FROM (SELECT '91' || (9000000000 + c_custkey % 400 * 2)::VARCHAR AS alias, CASE WHEN c_custkey % 400 % 5 = 0 THEN 'm' || c_custkey % 60 ELSE (c_custkey % 40)::VARCHAR END AS c FROM customer) GROUP BY 1)"


def _amap(spark, d):
    k = F.col("c_custkey")
    canonical = F.when(k % 400 % 5 == 0, F.concat(F.lit("m"), (k % 60).cast("string"))).otherwise((k % 40).cast("string"))
    rows = V.table(spark, d, "customer").select(F.concat(F.lit("91"), (k % 400 * 2 + 9000000000).cast("string")).alias("alias"), canonical.alias("canonical"))
    return J.finalize_map(rows)


HIT = "LEFT JOIN amap a ON a.alias = phone LEFT JOIN amap b ON b.alias = plain"


@query(
    "j1_canonicalize_ids",
    AMAP + norm_sql("messy") + f"SELECT id, CASE WHEN phone = '' THEN '' WHEN a.alias IS NOT NULL THEN coalesce(a.canonical, '') WHEN b.alias IS NOT NULL THEN coalesce(b.canonical, '') ELSE phone END AS canonical, CASE WHEN phone = '' THEN 'missing' WHEN coalesce(a.ambiguous, b.ambiguous) THEN 'ambiguous_mapping' WHEN coalesce(a.ambiguous, b.ambiguous) IS NOT NULL THEN 'explicit_mapping' ELSE 'normalized_identifier' END AS canonical_reason FROM norm {HIT}",
)
def j1(spark, d):
    return J.canonicalize_ids(V.messy(spark, d).select("id", "raw"), "raw", True, _amap(spark, d)).drop("raw")


@query("j2_canonicalize_ids_drop", AMAP + ", bmap AS (FROM amap WHERE NOT ambiguous)" + norm_sql("messy") + "SELECT id, CASE WHEN phone = '' THEN '' ELSE coalesce(a.canonical, b.canonical, phone) END AS canonical, CASE WHEN phone = '' THEN 'missing' WHEN coalesce(a.alias, b.alias) IS NOT NULL THEN 'explicit_mapping' ELSE 'normalized_identifier' END AS canonical_reason FROM norm LEFT JOIN bmap a ON a.alias = phone LEFT JOIN bmap b ON b.alias = plain")
def j2(spark, d):
    return J.canonicalize_ids(V.messy(spark, d).select("id", "raw"), "raw", True, _amap(spark, d), policy="drop_ambiguous").drop("raw")


@query("x2_ambiguous_aliases", "SELECT imsi AS alias, count(DISTINCT subscriber_id) AS canonicals FROM subscribers GROUP BY 1 HAVING count(DISTINCT subscriber_id) > 1 UNION ALL SELECT imei, count(DISTINCT subscriber_id) FROM subscribers GROUP BY 1 HAVING count(DISTINCT subscriber_id) > 1")
def x2(spark, d):
    s = V.subscribers(spark, d)
    rows = s.select(F.col("imsi").alias("alias"), F.col("subscriber_id").alias("canonical")).unionByName(s.select(F.col("imei").alias("alias"), F.col("subscriber_id").alias("canonical")))
    return J.ambiguous_aliases(rows)


SRC = ", src AS (SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN '' ELSE caller END AS subject, CASE event_id % 13 WHEN 0 THEN 'missing' WHEN 1 THEN 'ambiguous_mapping' ELSE 'normalized_identifier' END AS sr, receiver AS contact, CASE event_id % 17 WHEN 0 THEN 'invalid' WHEN 1 THEN 'invalid_zone' WHEN 2 THEN 'explicit' ELSE 'assumed' END AS st FROM calls)"


def _src(spark, d):
    k, t = F.col("event_id") % 13, F.col("event_id") % 17
    return V.calls(spark, d).select(
        "event_id", "ts", F.when(k == 0, "").otherwise(F.col("caller")).alias("subject"), F.when(k == 0, "missing").when(k == 1, "ambiguous_mapping").otherwise("normalized_identifier").alias("subject_reason"),
        F.col("receiver").alias("contact"), F.lit("normalized_identifier").alias("contact_reason"), F.when(t == 0, "invalid").when(t == 1, "invalid_zone").when(t == 2, "explicit").otherwise("assumed").alias("ts_status"),
    )


@query("a1_source_summary", SRC + "SELECT count(*) AS rows, count(*) FILTER (subject = '') AS missing_id_rows, count(*) FILTER (sr = 'ambiguous_mapping') AS ambiguous_rows, count(*) FILTER (st IN ('invalid', 'invalid_zone')) AS invalid_timestamp_rows, count(*) FILTER (st = 'invalid_zone') AS invalid_zone_rows, count(DISTINCT subject) FILTER (subject <> '') AS subjects, count(DISTINCT contact) AS contacts FROM src")
def a1(spark, d):
    return E.source_summary(_src(spark, d))


@query("a2_subject_activity", SRC + f"SELECT subject, count(*) AS rows, strftime(min(ts), {DUCK_ISO}) AS first_ts, strftime(max(ts), {DUCK_ISO}) AS last_ts FROM src WHERE subject <> '' GROUP BY 1")
def a2(spark, d):
    return E.subject_activity(_src(spark, d), "subject").select("subject", "rows", iso("first_ts").alias("first_ts"), iso("last_ts").alias("last_ts"))


@query("a3_contact_activity", "SELECT receiver AS contact, count(*) AS rows FROM calls GROUP BY 1")
def a3(spark, d):
    return E.contact_activity(_src(spark, d), "contact")


@query("a4_timestamp_quality", SRC + "SELECT count(*) AS total, count(*) FILTER (st IN ('explicit', 'assumed')) AS valid, count(*) FILTER (st LIKE 'invalid%') AS invalid, count(*) FILTER (st = 'invalid_zone') AS bad_zone, 'invalid_timezone_values' AS zone_status FROM src")
def a4(spark, d):
    return E.timestamp_quality(_src(spark, d))


@query("a5_observation_overlap", f"SELECT strftime(greatest(min(ts) FILTER (event_id % 2 = 0), min(ts) FILTER (event_id % 2 = 1)), {DUCK_ISO}) AS start_ts, strftime(least(max(ts) FILTER (event_id % 2 = 0), max(ts) FILTER (event_id % 2 = 1)), {DUCK_ISO}) AS end_ts, 'overlap' AS status FROM ev")
def a5(spark, d):
    c = V.calls(spark, d)
    return E.observation_overlap(c.where("event_id % 2 = 0"), c.where("event_id % 2 = 1")).select(iso("start_ts").alias("start_ts"), iso("end_ts").alias("end_ts"), "status")


TWO = ", sa AS (SELECT CASE WHEN caller::INT % 4 = 1 THEN 'c' || caller ELSE caller END AS subject, count(*) AS rows, min(ts) AS f, max(ts) AS l FROM calls GROUP BY 1), sb AS (SELECT CASE WHEN subscriber::INT % 5 = 2 THEN 's' || subscriber ELSE subscriber END AS subject, count(*) AS rows, min(ts) AS f, max(ts) AS l FROM sessions GROUP BY 1), mt AS (SELECT subject, CASE WHEN sa.rows IS NOT NULL AND sb.rows IS NOT NULL THEN 'matched' WHEN sa.rows IS NOT NULL THEN 'cdr_only' ELSE 'ipdr_only' END AS status FROM sa FULL JOIN sb USING (subject))"


def _two(spark, d):
    # subjects that only one source knows, without leaving out a row
    a = V.calls(spark, d).withColumn("caller", F.when(F.col("caller").cast("int") % 4 == 1, F.concat(F.lit("c"), "caller")).otherwise(F.col("caller")))
    b = V.sessions(spark, d).withColumn("subscriber", F.when(F.col("subscriber").cast("int") % 5 == 2, F.concat(F.lit("s"), "subscriber")).otherwise(F.col("subscriber")))
    return a, b, E.subject_activity(a, "caller"), E.subject_activity(b, "subscriber")


COVER = "SELECT matched, cdr_only, ipdr_only, round(matched / (matched + cdr_only)::DOUBLE, 6) AS cdr_coverage, round(matched / (matched + ipdr_only)::DOUBLE, 6) AS ipdr_coverage FROM (SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'cdr_only') AS cdr_only, count(*) FILTER (status = 'ipdr_only') AS ipdr_only FROM mt)"


@query("a6_match_coverage", TWO + COVER)
def a6(spark, d):
    _, _, a, b = _two(spark, d)
    return E.match_coverage(E.match_subjects(a, b)).select("matched", "cdr_only", "ipdr_only", F.round("cdr_coverage", 6).alias("cdr_coverage"), F.round("ipdr_coverage", 6).alias("ipdr_coverage"))


@query("j8_contact_only", "SELECT DISTINCT receiver AS contact FROM calls WHERE receiver NOT IN (SELECT subscriber FROM sessions WHERE destination IN (SELECT destination FROM sessions GROUP BY 1 HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM sessions GROUP BY destination))))")
def j8(spark, d):
    c = V.calls(spark, d)
    # subjects: all users of the rarest destinations
    used = V.sessions(spark, d)
    n = used.groupBy("destination").agg(F.count(F.lit(1)).alias("n"))
    rarest = n.join(F.broadcast(n.agg(F.min("n").alias("n"))), "n")  # one row
    subjects = used.join(rarest, "destination", "left_semi").select(F.col("subscriber").alias("subject"))
    return E.contact_only(subjects, c.select(F.col("receiver").alias("contact")))


@query("j9_match_subjects", TWO + "SELECT * FROM mt")
def j9(spark, d):
    _, _, a, b = _two(spark, d)
    return E.match_subjects(a, b)


@query("j10_matched_details", TWO + f"SELECT subject, sa.rows AS cdr_rows, strftime(sa.f, {DUCK_ISO}) AS cdr_first, strftime(sa.l, {DUCK_ISO}) AS cdr_last, sb.rows AS ipdr_rows, strftime(sb.f, {DUCK_ISO}) AS ipdr_first, strftime(sb.l, {DUCK_ISO}) AS ipdr_last FROM sa JOIN sb USING (subject)")
def j10(spark, d):
    _, _, a, b = _two(spark, d)
    m = E.matched_details(a, b)
    return m.select("subject", "cdr_rows", iso("cdr_first_ts").alias("cdr_first"), iso("cdr_last_ts").alias("cdr_last"), "ipdr_rows", iso("ipdr_first_ts").alias("ipdr_first"), iso("ipdr_last_ts").alias("ipdr_last"))


@query("o1_intersect_subjects", TWO + "SELECT subject FROM sa INTERSECT SELECT subject FROM sb")
def o1(spark, d):
    _, _, a, b = _two(spark, d)
    return a.select("subject").intersect(b.select("subject"))


@query("o2_difference_subjects", TWO + "SELECT subject, 'cdr_only' AS side FROM (SELECT subject FROM sa EXCEPT SELECT subject FROM sb) UNION ALL SELECT subject, 'ipdr_only' FROM (SELECT subject FROM sb EXCEPT SELECT subject FROM sa)")
def o2(spark, d):
    _, _, a, b = _two(spark, d)
    a, b = a.select("subject"), b.select("subject")
    return a.subtract(b).withColumn("side", F.lit("cdr_only")).unionByName(b.subtract(a).withColumn("side", F.lit("ipdr_only")))


DEC = ", g AS (SELECT caller::INT % 40 AS g, count(DISTINCT caller) AS n, count(DISTINCT receiver) AS p FROM calls GROUP BY 1), ev2 AS (SELECT g, ((n - 1) % 3)::BIGINT AS n, ((p - 1) % 3)::BIGINT AS p, least((n - 1) % 3, (p - 1) % 3)::BIGINT AS m FROM g)"


@query(
    "x4_identity_decision",
    DEC
    + """, w AS (SELECT *, CASE g % 5 WHEN 0 THEN 'same_person' WHEN 1 THEN 'different_people' WHEN 2 THEN 'multiple_person_dataset' WHEN 3 THEN 'not_sure' END AS answer FROM ev2),
u AS (SELECT *, CASE WHEN g % 7 = 0 THEN 'combined' WHEN answer = 'same_person' THEN 'combined' WHEN answer = 'different_people' THEN 'separate_sources' WHEN answer = 'multiple_person_dataset' THEN 'multi_person_conditioned' WHEN answer = 'not_sure' THEN 'review_required' END AS mode FROM w)
SELECT g, answer, mode, answer IS NOT NULL AND n >= 1 AND CASE answer WHEN 'same_person' THEN n = 1 AND p = 1 AND m = 1 WHEN 'different_people' THEN mode <> 'combined' WHEN 'multiple_person_dataset' THEN mode <> 'combined' ELSE mode <> 'combined' END AS allowed FROM u""",
)
def x4(spark, d):
    g = V.calls(spark, d).groupBy((F.col("caller").cast("int") % 40).alias("g")).agg(F.count_distinct("caller").alias("n"), F.count_distinct("receiver").alias("p"))
    n, p = (F.col("n") - 1) % 3, (F.col("p") - 1) % 3
    ev = g.select("g", F.lit(True).alias("cdr_present"), F.lit(True).alias("ipdr_present"), n.alias("cdr_count"), p.alias("ipdr_count"), F.least(n, p).alias("matched"), F.lit(0).alias("ambiguous"))
    k = F.col("g") % 5
    answer = F.when(k == 0, "Same Person").when(k == 1, "different").when(k == 2, "multiple-person dataset").when(k == 3, "not_sure")
    return E.identity_decision(ev, answer, F.when(F.col("g") % 7 == 0, "same-person")).select("g", "answer", "mode", "allowed")


def _listed(report, key, source, **values):
    """One report of X5 as rows of text, for DuckDB; values: name and SQL expression."""
    names = ", ".join(f"'{n}'" for n in values)
    return f"SELECT '{report}' AS report, {key} AS key, unnest([{names}]) AS name, unnest([{', '.join(f'({v})::VARCHAR' for v in values.values())}]) AS value FROM {source}"


def _x5_sql():
    at = lambda c: f"strftime({c}, {DUCK_ISO})"
    status = "CASE k % 11 WHEN 0 THEN 'invalid' WHEN 1 THEN 'explicit' ELSE 'assumed' END"
    reason = "CASE WHEN k % 9 = 0 THEN 'ambiguous_mapping' ELSE 'ok' END"
    n = lambda test: f"count(*) FILTER ({test})"
    parts, sql = [], ""
    for name, table, subject, contact in (
        ("cdr", "calls", "CASE WHEN k % 13 = 0 THEN '' WHEN caller::INT % 4 = 1 THEN 'c' || caller ELSE caller END", "receiver"),
        ("ipdr", "(SELECT *, port::BIGINT AS k FROM sessions)", "CASE WHEN k % 13 = 0 THEN '' WHEN subscriber::INT % 5 = 2 THEN 's' || subscriber ELSE subscriber END", "subscriber"),
    ):
        sql += f", {name} AS (SELECT {subject} AS subject, {contact} AS contact, {reason} AS sr, 'ok' AS cr, CASE WHEN k % 11 > 0 THEN ts END AS ts, {status} AS st FROM {table}), {name}_s AS (SELECT subject, count(*) AS rows, min(ts) AS f, max(ts) AS l FROM {name} WHERE subject <> '' GROUP BY 1), {name}_f AS (SELECT count(*) AS rows, {digest_sql('subject', 'contact', 'sr', 'cr', at('ts'), 'st')} AS digest FROM {name})"
        parts += [
            _listed(f"{name}_summary", "''", name, rows="count(*)", missing_id_rows=n("subject = ''"), ambiguous_rows=n("sr <> 'ok'"), invalid_timestamp_rows=n("st = 'invalid'"), invalid_zone_rows="0", subjects="count(DISTINCT subject) FILTER (subject <> '')", contacts="count(DISTINCT contact)"),
            _listed(f"{name}_times", "''", name, total="count(*)", valid=n("st <> 'invalid'"), invalid=n("st = 'invalid'"), bad_zone="0", zone_status="'mixed_explicit_and_assumed'"),
            _listed(f"{name}_subjects", "subject", f"{name}_s", rows="rows", first_ts=at("f"), last_ts=at("l")),
            _listed(f"{name}_contacts", "contact", f"(SELECT contact, count(*) AS n FROM {name} GROUP BY 1)", rows="n"),
            _listed(f"{name}_contact_only", "contact", f"(SELECT contact FROM {name} EXCEPT SELECT subject FROM {name})", contact="contact"),
            _listed(f"{name}_fingerprint", "''", f"{name}_f", rows="rows", digest="digest"),
        ]
    sql += ", mt AS (SELECT subject, CASE WHEN a.rows IS NOT NULL AND b.rows IS NOT NULL THEN 'matched' WHEN a.rows IS NOT NULL THEN 'cdr_only' ELSE 'ipdr_only' END AS status FROM cdr_s a FULL JOIN ipdr_s b USING (subject)), cv AS (" + COVER + ")"
    sql += ", ov AS (SELECT greatest(a.f, b.f) AS s, least(a.l, b.l) AS e FROM (SELECT min(f) AS f, max(l) AS l FROM cdr_s) a, (SELECT min(f) AS f, max(l) AS l FROM ipdr_s) b)"
    counts = {c: c for c in ("matched", "cdr_only", "ipdr_only", "cdr_coverage", "ipdr_coverage")}
    period = {"start_ts": at("s"), "end_ts": at("e")}
    parts += [
        _listed("overlap", "''", "ov", **period, status="'overlap'"),
        _listed("coverage", "''", "cv", **counts),
        _listed("matches", "subject", "mt", status="status"),
        _listed("matched_details", "subject", "cdr_s a JOIN ipdr_s b USING (subject)", cdr_rows="a.rows", cdr_first_ts=at("a.f"), cdr_last_ts=at("a.l"), ipdr_rows="b.rows", ipdr_first_ts=at("b.f"), ipdr_last_ts=at("b.l")),
        _listed("check", "''", "cdr_f a, ipdr_f b", fingerprint="sha256('country=91' || chr(10) || 'zone=Asia/Kolkata' || chr(10) || a.rows || ' ' || a.digest || chr(10) || b.rows || ' ' || b.digest)"),
        _listed("evidence", "''", "cv, ov", cdr_present="'true'", ipdr_present="'true'", cdr_count="matched + cdr_only", ipdr_count="matched + ipdr_only", **counts, period_status="'overlap'", **period, ambiguous="SELECT count(*) FROM (SELECT imsi FROM subscribers GROUP BY 1 HAVING count(*) > 1)", proves_identity="'false'"),
    ]
    return sql + ", every AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM every WHERE value IS NOT NULL"


@query("x5_two_source_evidence", _x5_sql())
def x5(spark, d):
    a, b, _, _ = _two(spark, d)
    amap = J.finalize_map(V.subscribers(spark, d).select(F.col("imsi").alias("alias"), F.col("subscriber_id").alias("canonical")))
    k = F.col("k")

    def source(df, subject, contact):
        return df.select(
            F.when(k % 13 == 0, "").otherwise(subject).alias("subject"), contact.alias("contact"), F.when(k % 9 == 0, "ambiguous_mapping").otherwise("ok").alias("subject_reason"), F.lit("ok").alias("contact_reason"),
            F.when(k % 11 > 0, F.date_trunc("second", "ts")).alias("ts"), F.when(k % 11 == 0, "invalid").when(k % 11 == 1, "explicit").otherwise("assumed").alias("ts_status"),
        )

    cdr = source(a, F.col("caller"), F.col("receiver"))
    ipdr = source(b.withColumn("k", F.col("port").cast("long")), F.col("subscriber"), F.ltrim(F.col("subscriber"), F.lit("s")))
    out = None
    for name, df in E.evidence_reports(cdr, ipdr, amap, {"zone": "Asia/Kolkata", "country": "91"}).items():
        key = next((c for c in ("subject", "contact") if c in df.columns), None)
        text = [iso(c) if t == "timestamp" else F.round(c, 6).cast("string") if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), x.alias("value")) for c, x in zip(df.columns, text, strict=True) if c != key or len(df.columns) == 1])
        rows = df.select(F.lit(name).alias("report"), (F.col(key) if key else F.lit("")).alias("key"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out.where("value IS NOT NULL")
