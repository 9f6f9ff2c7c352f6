"""Per-agent reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringdata.operators.edges import numbered
from ringdata.operators.order import medians
from ringdata.sources.tables import stored


def orientations(calls: DataFrame) -> DataFrame:
    """Each call seen from either end: agent, other, direction and the call's own columns; one pass over the calls."""
    end = lambda agent, other, direction: F.struct(F.col(agent).alias("agent"), F.col(other).alias("other"), F.lit(direction).alias("direction"))
    return calls.select(F.inline(F.array(end("caller", "receiver", "outgoing"), end("receiver", "caller", "incoming"))), "ts", "duration", "event_type")


def contact_summary(calls: DataFrame) -> DataFrame:
    """Per (agent, other): calls each way, seconds, last instant and the last call's type (ties: the greater type).

    Calls are summed for each type first, in numbers only, so that no task sorts them; the last type comes from the types' last instants.
    """
    typed = orientations(calls).groupBy("agent", "other", "event_type").agg(F.count_if(F.col("direction") == "outgoing").alias("out"), F.count_if(F.col("direction") == "incoming").alias("in"), F.sum("duration").alias("s"), F.max("ts").alias("t"))
    return typed.groupBy("agent", "other").agg(
        F.sum("out").alias("outgoing"), F.sum("in").alias("incoming"), F.sum("s").alias("seconds"), F.max("t").alias("last_ts"), F.max_by("event_type", F.struct("t", "event_type")).alias("last_type"),
    )


def enrich_contacts(contacts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """The other party's id and region by msisdn; kind core_agent if found, else the given kind, else external_contact."""
    known = subscribers.select(F.col("msisdn").alias("other_msisdn"), F.col("subscriber_id").alias("other_id"), F.col("region").alias("other_region"))
    out = contacts.join(known, "other_msisdn", "left")
    return out.withColumn("kind", F.when(F.col("other_id").isNotNull(), "core_agent").otherwise(F.coalesce("given_kind", F.lit("external_contact")))).drop("given_kind")


def location_points(calls: DataFrame) -> DataFrame:
    """Per (agent, lat, lng at 5 digits, tower): calls and last instant; tower is the first of three columns that is not blank."""
    named = F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("tower1", "tower2", "tower3")], F.lit("Unknown tower"))
    ok = F.col("lat").between(6.0, 38.5) & F.col("lng").between(67.0, 98.5)
    keyed = calls.where(ok).select("agent", F.bround("lat", 5).alias("lat"), F.bround("lng", 5).alias("lng"), named.alias("tower"), "ts")
    return keyed.groupBy("agent", "lat", "lng", "tower").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


# Circle centres and the default one.
CENTRES = {"GJ": (22.2587, 71.1924), "DL": (28.6139, 77.2090), "KA": (15.3173, 75.7139), "MH": (19.7515, 75.7139), "RJ": (27.0238, 74.2179), "UP": (26.8467, 80.9462), "WB": (22.9868, 87.8550)}
DEFAULT_CENTRE = (22.5937, 78.9629)


def agent_centroid(points: DataFrame, agents: DataFrame) -> DataFrame:
    """Count-weighted median of latitude and of longitude; else the circle's centre; else the default. agents: agent, circle."""
    # points stand at five digits (A20), so that hundred-thousandths of a degree are whole numbers
    axes = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.round(F.col(c) * 100_000).cast("long").alias("value")) for c in ("lat", "lng")])).alias("at")
    whole = stored(points.where("agent IS NOT NULL").select("agent", "n", axes).groupBy("agent", "at.axis", "at.value").agg(F.sum("n").alias("n")), "axes")
    mid = medians(whole, ["agent", "axis"], "value", "n").withColumn("x", (F.col("low") + F.col("high")) / 200_000)
    mid = mid.groupBy("agent").agg(*[F.max(F.when(F.col("axis") == c, F.col("x"))).alias(c) for c in ("lat", "lng")])
    out = agents.join(mid, "agent", "left")
    place = lambda k: F.coalesce(*[F.when(F.col("circle") == c, F.lit(xy[k])) for c, xy in CENTRES.items()], F.lit(DEFAULT_CENTRE[k]))
    return out.select("agent", F.coalesce("lat", place(0)).alias("lat"), F.coalesce("lng", place(1)).alias("lng"))


def hourly_histogram(calls: DataFrame) -> DataFrame:
    """Agent, hour, n (a call between two agents counts for both); agent '*' holds the sums."""
    per = orientations(calls).groupBy("agent", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return per.unionByName(per.groupBy("hour").agg(F.sum("n").alias("n")).select(F.lit("*").alias("agent"), "hour", "n"))


def agent_stats(calls: DataFrame, sessions: DataFrame, edges: DataFrame, agents: DataFrame) -> DataFrame:
    """14 measures per agent."""
    ends = orientations(calls)
    out, into = F.col("direction") == "outgoing", F.col("direction") == "incoming"
    # sums of each contact first: counting several columns' distinct values at once would copy every call for each
    met = ends.groupBy("agent", "other").agg(F.count_if(out).alias("out"), F.count_if(into).alias("in"), F.sum("duration").alias("s"), F.max("ts").alias("t"))
    known = F.col("other").isNotNull()
    a = met.groupBy("agent").agg(
        F.sum("out").alias("outgoing_calls"), F.sum("in").alias("incoming_calls"), F.sum("s").alias("call_seconds"), F.count("other").alias("contacts"),
        F.count_if(known & (F.col("out") > 0)).alias("outgoing_contacts"), F.count_if(known & (F.col("in") > 0)).alias("incoming_contacts"), F.max("t").alias("last_call"),
    ).join(ends.groupBy("agent").agg(F.count_distinct(F.to_date("ts")).alias("call_days")), "agent")
    s = sessions.groupBy(F.col("subscriber").alias("agent")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("mb").alias("mb"), F.count_distinct("destination").alias("destinations"), F.count_distinct("port").alias("ports"), F.max("ts").alias("last_session"))
    e = edges.select(F.explode(F.array("lo", "hi")).alias("agent")).groupBy("agent").agg(F.count(F.lit(1)).alias("friends"))
    joined = agents.select("agent").join(a, "agent", "left").join(s, "agent", "left").join(e, "agent", "left")
    zero = ["outgoing_calls", "incoming_calls", "call_seconds", "contacts", "outgoing_contacts", "incoming_contacts", "call_days", "sessions", "mb", "destinations", "ports", "friends"]
    return joined.select("agent", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], (F.coalesce("outgoing_calls", F.lit(0)) + F.coalesce("incoming_calls", F.lit(0))).alias("calls"), F.greatest("last_call", "last_session").alias("last_activity"))


def dashboard_totals(calls: DataFrame, sessions: DataFrame, oriented_edges: DataFrame, agents: DataFrame) -> DataFrame:
    """One row; an undirected edge stands twice in oriented_edges."""
    known = agents.select(F.col("agent").alias("receiver")).distinct()
    parts = [
        agents.agg(F.count_distinct("agent").alias("agents")), calls.agg(F.count(F.lit(1)).alias("calls")), sessions.agg(F.count(F.lit(1)).alias("sessions"), F.sum("mb").alias("mb")),
        oriented_edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges")), calls.join(known, "receiver", "left_semi").agg(F.count(F.lit(1)).alias("incoming_core_calls")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))  # one row each
    return out


def dataset_summary(calls: DataFrame, sessions: DataFrame, edges: DataFrame, agents: DataFrame) -> DataFrame:
    """Metric, n."""
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    return count("agents", agents).unionByName(count("calls", calls)).unionByName(count("sessions", sessions)).unionByName(count("edges", edges))


def same_group_share(calls: DataFrame, people: DataFrame, attribute: str) -> DataFrame:
    """Share of calls between known people whose ends have the same attribute."""
    a, b = people.select(F.col("person").alias("caller"), F.col(attribute).alias("x")), people.select(F.col("person").alias("receiver"), F.col(attribute).alias("y"))
    both = calls.join(a, "caller").join(b, "receiver")
    return both.agg(F.count(F.lit(1)).alias("calls"), F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("share"))


def device_audit(subscribers: DataFrame) -> DataFrame:
    """Shared devices (an imei of several imsi or msisdn) and SIM swaps (an imsi of several imei)."""
    shared = subscribers.groupBy(F.col("imei").alias("key")).agg(F.greatest(F.count_distinct("imsi"), F.count_distinct("msisdn")).alias("others")).where("others > 1").select(F.lit("shared_device").alias("finding"), "key", "others")
    swapped = subscribers.groupBy(F.col("imsi").alias("key")).agg(F.count_distinct("imei").alias("others")).where("others > 1").select(F.lit("sim_swap").alias("finding"), "key", "others")
    return shared.unionByName(swapped)


def top_values(df: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """The k most common values of every key (ties by value); blank counts as Unknown."""
    named = F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) == "", "Unknown").otherwise(F.col(value))
    counts = df.groupBy(key, named.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


#: The lists of an agent's document, in its order.
PARTS = ("contacts", "friends", "locations", "calls", "sessions")
LINE = ["agent", "part", "order", "name", "ts", "direction", "duration", "event_type", "outgoing", "incoming", "seconds", "last_type", "known_friend", "lat", "lng", "n", "score", "destination", "port", "mb"]


#: Rows of a list that one task may place; longer lists are placed by ranges.
LIST_ROWS = 1_000_000


def _line_rows(calls: DataFrame, sessions: DataFrame, edges: DataFrame, points: DataFrame, agents: DataFrame) -> DataFrame:
    """The columns of LINE of every item of the agents' lists; part is its place in PARTS."""
    scored = edges if "score" in edges.columns else edges.withColumn("score", F.lit(None).cast("double"))
    ends = scored.select(F.inline(F.array(F.struct(F.col("lo").alias("agent"), F.col("hi").alias("name"), "score"), F.struct(F.col("hi").alias("agent"), F.col("lo").alias("name"), "score"))))
    friends = ends.select("agent", "name").distinct().withColumn("known_friend", F.lit(True))
    contacts = contact_summary(calls).withColumnRenamed("other", "name").join(friends, ["agent", "name"], "left")
    kinds = {
        "contacts": contacts.withColumns({"order": -(F.col("outgoing") + F.col("incoming")), "known_friend": F.coalesce("known_friend", F.lit(False))}).withColumnRenamed("last_ts", "ts"),
        "friends": ends.withColumn("order", -F.coalesce("score", F.lit(-1.0))),
        "locations": points.withColumnsRenamed({"tower": "name", "last_ts": "ts"}).withColumn("order", -F.col("n")),
        "calls": orientations(calls).withColumnRenamed("other", "name").withColumn("order", -F.unix_micros("ts")),
        "sessions": sessions.select(F.col("subscriber").alias("agent"), "ts", "destination", "port", "mb").withColumn("order", -F.unix_micros("ts")),
    }
    out = None
    for part in PARTS:
        rows = kinds[part].withColumns({"part": F.lit(PARTS.index(part)), "order": F.col("order").cast("double")})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select(*LINE).join(agents.select("agent").distinct(), "agent", "left_semi")


def _placed(rows: DataFrame) -> DataFrame:
    """Stored rows with `k`, the place in their agent's part. Tasks hold whole agents, sorted by agent, part and place.

    Agents are dealt by hash, in one shuffle. Parts of more than LIST_ROWS rows are placed
    by one sort by ranges instead, each over many tasks; rows after a sort by ranges stand
    in tasks of their own, sorted too.
    """
    place = F.row_number().over(Window.partitionBy("agent", "part").orderBy(*LINE[2:]))
    whole = lambda df: df.repartition("agent").withColumn("k", place.cast("long"))
    large = stored(rows.groupBy("agent", "part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST_ROWS).select("agent", "part"), "long-lists")
    if large.isEmpty():
        return whole(rows)
    large = F.broadcast(large)  # at most one in LIST_ROWS rows
    ranged = numbered(rows.join(large, ["agent", "part"], "left_semi"), [F.col(c) for c in LINE], "_k")
    first = ranged.groupBy("agent", "part").agg(F.min("_k").alias("_first"))  # as many rows as large has
    apart = ranged.join(F.broadcast(first), ["agent", "part"]).withColumn("k", F.col("_k") - F.col("_first") + 1).sortWithinPartitions("agent", "part", "k")
    return whole(rows.join(large, ["agent", "part"], "left_anti")).unionByName(apart.select(*rows.columns, "k"))


def agent_lines(calls: DataFrame, sessions: DataFrame, edges: DataFrame, points: DataFrame, agents: DataFrame) -> DataFrame:
    """The lists of every agent, an item a row and none left out: contacts by (-calls, id), friends by (-score, id), location points by (-calls, tower), calls and sessions newest first.

    A row has the agent, the part of the document, its place `k` in that list (from 1) and
    the columns of its kind; the others are null. An agent with any share of all rows takes
    many tasks (_placed). edges: lo, hi and, where known, score; points: the rows of A20.
    Rows of people who are not in agents are left out.
    """
    placed = _placed(stored(_line_rows(calls, sessions, edges, points, agents), "lines"))
    return placed.select("agent", _part_name().alias("part"), "k", *LINE[3:])


def _part_name():
    return F.when(F.col("part") < 0, "stats").otherwise(F.element_at(F.array(*[F.lit(x) for x in PARTS]), F.greatest(F.col("part"), F.lit(0)) + 1))


def agent_documents(calls: DataFrame, sessions: DataFrame, edges: DataFrame, points: DataFrame, agents: DataFrame) -> DataFrame:
    """The rows of S10: agent_id, part, k and a struct with the item's own columns; part `stats` holds the 14 measures (A22) as its only item.

    Rows are dealt as _placed does: tasks are sorted by agent, part and place, the stats first.
    """
    calls, edges = stored(calls.select("caller", "receiver", "ts", "duration", "event_type"), "calls"), stored(edges, "edges")
    stats = agent_stats(calls, sessions, edges, agents).distinct()
    head = stats.select("agent", F.lit(-1).alias("part"), F.struct(*stats.columns[1:]).alias("stats"))
    rows = stored(head.unionByName(_line_rows(calls, sessions, edges, points, agents), allowMissingColumns=True), "documents")
    item = F.when(F.col("part") >= 0, F.struct(*LINE[3:]))
    return _placed(rows).select(F.col("agent").alias("agent_id"), _part_name().alias("part"), "k", "stats", item.alias("item"))


def latest_activity(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """The greatest of last outgoing, incoming and session instants."""
    ends = orientations(calls).select("agent", "ts").unionByName(sessions.select(F.col("subscriber").alias("agent"), "ts"))
    return ends.groupBy("agent").agg(F.max("ts").alias("last_ts"))
