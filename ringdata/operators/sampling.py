"""Seeded resampling (R1-R15). Every draw is a hash of (seed, key, index), so results do not depend on partitioning."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.functions.unicode import let
from ringdata.operators import edges as G
from ringdata.operators.edges import rank_hash, uniform
from ringdata.operators.sets import set_parts
from ringdata.sources.tables import stored


# Circles with weights, tier-1 circles, towers and shares.
CIRCLES = {"MH": 0.20, "DL": 0.15, "KA": 0.15, "UP": 0.30, "WB": 0.20}
TIER_1 = ["MH", "DL", "KA"]
HOME_TOWERS, EVENING_TOWERS, EVENING_HOUR = (1000, 1500), (2000, 2200), 18
CALL_SHARE, DUMMY_REUSE = 0.22, 2
#: The golden section in billionths.
GOLDEN = 618_033_989
START = "2026-06-15 00:00:00"


def plan_profiles(sources: DataFrame, target: int, seed: int = 7, template: bool = False) -> DataFrame:
    """agent_id, source_id, is_extra. sources: person, calls.

    At most `target` sources: the most active. Fewer: all, and extras whose i-th takes
    source (i + seed mod n) mod n by rank. One source alone needs template=True.
    """
    n = sources.count()
    if n == 0:
        raise ValueError("no source profiles")
    order = [F.col("calls").desc(), F.col("person")]
    if target <= n:
        return sources.orderBy(*order).limit(target).select(F.col("person").alias("agent_id"), F.col("person").alias("source_id"), F.lit(False).alias("is_extra"))
    if n == 1 and not template:
        raise ValueError("one source is expanded in template mode only")
    ranked = G.sequential_ids(sources.select("person", (-F.col("calls")).alias("o")), ["o", "person"], "", 12).select(F.col("row_id").cast("long").alias("rank"), "person")
    spark = sources.sparkSession
    extra = spark.range(target - n).select((F.col("id") + 1).alias("i"), F.pmod(F.col("id") + seed % n, F.lit(n)).alias("rank"))
    made = extra.join(ranked, "rank").select(F.concat(F.lit("SYNTHETIC_AGENT_"), F.lpad(F.col("i").cast("string"), 7, "0")).alias("agent_id"), F.col("person").alias("source_id"), F.lit(True).alias("is_extra"))
    return ranked.select(F.col("person").alias("agent_id"), F.col("person").alias("source_id"), F.lit(False).alias("is_extra")).unionByName(made)


def inherit_profiles(behaviour: DataFrame, plan: DataFrame, key: str = "person") -> DataFrame:
    """R2: behaviour rows of every agent, those of its source."""
    return plan.select("agent_id", "source_id").join(behaviour, F.col("source_id") == F.col(key)).drop(key, "source_id")


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """person, name, value, low, high, total: cumulative counts of a value within a person."""
    counts = df.groupBy(F.col(key).alias("person"), F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("person").orderBy("value")  # the distinct values of one person
    return counts.select("person", F.lit(value).alias("name"), "value", (F.sum("n").over(w) - F.col("n")).alias("low"), F.sum("n").over(w).alias("high"), F.sum("n").over(Window.partitionBy("person")).alias("total"))


def draw(rows: DataFrame, dist: DataFrame, name: str, seed: int) -> DataFrame:
    """rows (agent, i, person) with a value drawn from the person's distribution.

    The inverse of the distribution is an equi-join on (person, index): a value with
    count n stands for n indexes, in blocks of STEP, so that the join has no inequality
    over a whole person.
    """
    step = 64
    mine = dist.where(F.col("name") == name)
    totals = mine.select("person", "total").distinct()
    at = F.floor(uniform(seed, F.lit(name), "agent", "i") * F.col("total"))
    keyed = rows.join(totals, "person").withColumn("at", at).withColumn("block", F.floor(F.col("at") / step)).drop("total")
    spread = mine.select("person", "value", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))).alias("block"))
    return keyed.join(spread, ["person", "block"]).where("at >= low AND at < high").select(*rows.columns, F.col("value").alias(name))


def resample_events(plan: DataFrame, sources: dict[str, tuple[DataFrame, str, str]], n_per_agent: int, days: int = 7, seed: int = 7, start: str = START) -> DataFrame:
    """Exactly n rows per agent; each named value drawn on its own from the source's distribution, the time uniform but for `hour`.

    sources: name -> (table, person column, value column).
    """
    rows = plan.select(F.col("agent_id").alias("agent"), F.col("source_id").alias("person")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_per_agent - 1))).alias("i"))
    for name, (df, key, value) in sources.items():
        dist = distribution(df, key, value).withColumn("name", F.lit(name))
        rows = draw(rows, dist, name, seed)
    u = lambda what: uniform(seed, F.lit(what), "agent", "i")
    hour = F.col("hour").cast("int") if "hour" in sources else F.floor(u("hour") * 24)
    seconds = F.floor(u("day") * days) * 86_400 + hour * 3_600 + F.floor(u("second") * 3_600)
    return rows.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + seconds.cast("long")))


def friend_adjacency(edges: DataFrame, share: DataFrame) -> DataFrame:
    """Node, part, friends (sorted, of bounded size; a node of very many has several parts) and share (0 where none). share: node, share."""
    near = set_parts(G.both_directions(edges), "node", "other", "friends")
    return near.join(share, "node", "left").select("node", "part", "friends", F.coalesce("share", F.lit(0.0)).alias("share"))


def sample_neighbor(nodes: DataFrame, edges: DataFrame, seed: int = 7) -> DataFrame:
    """Node, neighbor: the one of the least hash, which is uniform; a node without edges gets itself."""
    best = G.both_directions(edges).groupBy("node").agg(F.min(F.struct(rank_hash(seed, "node", "other").alias("h"), "other")).alias("b"))
    return nodes.join(best, "node", "left").select("node", F.coalesce("b.other", "node").alias("neighbor"))


def pick(rows: DataFrame, choices: DataFrame, value: str, what: str, seed: int) -> DataFrame:
    """rows (agent, i, ...) with one of the agent's distinct values of `choices`, null where it has none: a rank is drawn and joined on (agent, rank)."""
    some = choices.select("agent", value).distinct()
    ranked = some.select("agent", value, (F.row_number().over(Window.partitionBy("agent").orderBy(value)) - 1).cast("long").alias("_at"))
    drawn = rows.join(some.groupBy("agent").agg(F.count(F.lit(1)).alias("_n")), "agent", "left").withColumn("_at", F.floor(uniform(seed, F.lit(what), "agent", "i") * F.col("_n")))
    return drawn.join(ranked, ["agent", "_at"], "left").drop("_at", "_n")


def route_calls(calls: DataFrame, shares: DataFrame, contacts: DataFrame, edges: DataFrame, seed: int = 7, default_share: float = CALL_SHARE) -> DataFrame:
    """Calls (agent, i) with receiver and contact_type.

    With the agent's share of cross links: one of its contacts, else a graph neighbour,
    else itself; otherwise an outside number. shares: agent, share; contacts: agent, contact.
    """
    near = G.both_directions(edges).select(F.col("node").alias("agent"), F.col("other").alias("_near"))
    rows = pick(calls, contacts.select("agent", F.col("contact").alias("_contact")), "_contact", "contact", seed)
    rows = pick(rows, near, "_near", "near", seed).join(shares, "agent", "left")
    linked = uniform(seed, F.lit("link"), "agent", "i") < F.coalesce("share", F.lit(default_share))
    inside = F.coalesce("_contact", "_near", "agent")
    outside = F.concat(F.lit("DUMMY_"), F.col("agent"), F.lit("_"), F.lpad(F.floor(F.col("i") / DUMMY_REUSE).cast("string"), 6, "0"))
    return rows.select(*calls.columns, F.when(linked, inside).otherwise(outside).alias("receiver"), F.when(linked, "known_friend").otherwise("dummy_entity").alias("contact_type"))


def bounded_reuse_ids(rows: DataFrame, owner: str, order: list[str], k: int = DUMMY_REUSE) -> DataFrame:
    """Rows with `dummy_id`, scoped to its owner and used at most k times."""
    n = F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1
    return rows.withColumn("dummy_id", F.concat(F.lit("DUMMY_"), F.col(owner), F.lit("_"), F.lpad(F.floor(n / k).cast("string"), 6, "0")))


def _numbered(nodes: DataFrame, seed: int) -> DataFrame:
    """Distinct nodes numbered from 0 in hash order."""
    hashed = nodes.select("node").distinct().withColumn("_h", rank_hash(seed, "node"))
    return G.numbered(hashed, ["_h", "node"], "at").select("at", "node")


def _pairs_of(drawn: DataFrame, numbered: DataFrame) -> DataFrame:
    a, b = numbered.select(F.col("at").alias("x"), F.col("node").alias("lo_")), numbered.select(F.col("at").alias("y"), F.col("node").alias("hi_"))
    return drawn.join(a, "x").join(b, "y").select("id", F.least("lo_", "hi_").alias("lo"), F.greatest("lo_", "hi_").alias("hi"))


def _ends(k: Column) -> Column:
    """Pair number k (0-based) as a struct of y > x: k = y (y - 1) / 2 + x, in whole numbers."""
    below = lambda y: F.when(y % 2 == 0, F.shiftright(y, 1) * (y - 1)).otherwise(y * F.shiftright(y - 1, 1))

    def settle(y: Column) -> Column:
        return F.when(below(y) > k, y - 1).when(below(y + 1) <= k, y + 1).otherwise(y)

    guess = F.floor((1 + F.sqrt(1 + 8 * k.cast("double"))) / 2).cast("long")
    return let(let(guess, settle), lambda y: F.struct((k - below(y)).alias("x"), y.alias("y")))


def _unrank(k: Column) -> tuple[Column, Column]:
    at = _ends(k)
    return at["x"], at["y"]


def _times(a: Column, step: int, modulus: int) -> Column:
    """a * step modulo a number below 2^62 for 0 <= a < modulus: in longs where they hold it, else in decimals."""
    if modulus < 1 << 31:
        return F.pmod(a * F.lit(step), F.lit(modulus))
    return F.pmod(a.cast("decimal(38,0)") * step, F.lit(modulus)).cast("long")


#: Places of the walk of one task, at most, and in a row: only the first of a row is multiplied out.
TASK_PLACES, ROW_PLACES = 1 << 20, 256


def _pair_walk(numbered: DataFrame, pairs: int, first: int, seed: int) -> DataFrame:
    """id, lo, hi: the first places of a walk over all pairs that meets each once.

    Pair numbers are unranked from id * step + start modulo the number of pairs, with a
    step near the golden section, so that any first part of the walk spreads evenly; the
    nodes behind the numbers are in hash order. Tasks follow the number of places.
    """
    modulus = max(1, pairs)
    step = next(s for s in itertools.count(max(1, pairs * GOLDEN // 10**9)) if math.gcd(s, modulus) == 1)
    rows = numbered.sparkSession.range(0, math.ceil(first / ROW_PLACES), 1, max(1, math.ceil(first / TASK_PLACES), min(64, first // ROW_PLACES)))
    start = F.pmod(_times(F.col("id"), step * ROW_PLACES % modulus, modulus) + F.lit(seed * 7919 % modulus), F.lit(modulus))
    jumps = F.array(*[F.lit(i * step % modulus).cast("long") for i in range(ROW_PLACES)])
    places = rows.select((F.col("id") * ROW_PLACES).alias("from"), start.alias("start"), F.posexplode(jumps).alias("i", "jump"))
    drawn = places.select((F.col("from") + F.col("i")).alias("id"), _ends(F.pmod(F.col("start") + F.col("jump"), F.lit(modulus))).alias("at")).where(F.col("id") < first)
    return _pairs_of(drawn.select("id", "at.x", "at.y"), numbered)


def sample_pairs_fraction(nodes: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    """max(1, round(fraction * N (N - 1) / 2)) distinct pairs, the first of the walk over all pairs."""
    numbered = stored(_numbered(nodes, seed), "nodes")
    n = numbered.count()
    pairs = n * (n - 1) // 2
    wanted = min(pairs, max(1, round(fraction * pairs))) if pairs else 0
    return _pair_walk(numbered, pairs, wanted, seed).select("lo", "hi")


def sample_non_edges(nodes: DataFrame, edges: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """N distinct pairs that are no edge; all such pairs if there are fewer.

    Of any n + E pairs at most E are edges, so the first n + E of the walk over all pairs
    hold enough, on graphs of any size and density; the first n that are no edge are kept.
    """
    numbered = stored(_numbered(nodes, seed), "nodes")
    count = numbered.count()
    pairs = count * (count - 1) // 2
    known = edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
    free = G.exclude_known_edges(_pair_walk(numbered, pairs, min(pairs, n + known.count()), seed), known)
    return G.numbered(free, ["id"], "_place").where(F.col("_place") < n).select("lo", "hi")


def assign_weighted(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Circle, device, tier and home tower of every row, by hash of its key."""
    u = lambda what: uniform(seed, F.lit(what), key)
    circle, upto = None, 0.0
    for name, w in CIRCLES.items():
        upto += w
        test = u("circle") < upto
        circle = F.when(test, name) if circle is None else circle.when(test, name)
    circle = circle.otherwise(next(reversed(CIRCLES)))
    out = df.withColumn("circle", circle)
    first = F.col("circle").isin(TIER_1)
    device = F.when(first, F.when(u("device") < 0.5, "5G").otherwise("4G")).otherwise(F.when(u("device") < 0.5, "4G").otherwise("2G"))
    tier = F.when(first & (u("tier") < 0.5), "premium").otherwise("basic")
    tower = F.concat(F.lit("TOWER_"), F.col("circle"), F.lit("_"), (F.lit(HOME_TOWERS[0]) + F.floor(u("tower") * (HOME_TOWERS[1] - HOME_TOWERS[0]))).cast("string"))
    return out.withColumns({"device": device, "tier": tier, "tower": tower})


def route_tower(df: DataFrame, key: list[str], seed: int = 7) -> DataFrame:
    """From hour 18 on another tower of the same circle."""
    other = F.concat(F.lit("TOWER_"), F.col("circle"), F.lit("_"), (F.lit(EVENING_TOWERS[0]) + F.floor(uniform(seed, *key) * (EVENING_TOWERS[1] - EVENING_TOWERS[0]))).cast("string"))
    return df.withColumn("routing_tower", F.when(F.hour("ts") >= EVENING_HOUR, other).otherwise(F.col("tower")))


def score_and_keep(candidates: DataFrame, score: str, fraction: float, a: str = "a", b: str = "b") -> DataFrame:
    """Without self pairs, the int(n * fraction) best of all n (self pairs counted in n), the best score per unordered pair."""
    n = candidates.count()
    kept = G.top_fraction(candidates.where(F.col(a) != F.col(b)), score, fraction, n, (a, b))
    return G.best_score_per_pair(kept, a, b, score)


def truth_pairs(nodes: DataFrame, edges: DataFrame, ratio: float, seed: int = 7) -> DataFrame:
    """Positives and round(ratio * positives) sampled negatives with ids and labels."""
    n = edges.count()
    both = G.union_truth(edges.select("lo", "hi"), sample_non_edges(nodes, edges, round(ratio * n), seed))
    return G.sequential_ids(both, [F.col("label").desc(), F.col("lo"), F.col("hi")], "TRUTH_", into="truth_pair_id")


def export_call_schema(calls: DataFrame, subscribers: DataFrame, seed: int = 7) -> DataFrame:
    """The 26-column call export; an SMS has duration 0. calls: event_id, caller, receiver, ts, duration, tower."""
    u = lambda what, low, high: (F.lit(low) + F.floor(uniform(seed, F.lit(what), "event_id") * (high - low + 1))).cast("string")
    j = G.sequential_ids(calls, ["event_id"], "", 1, "SL_NO").join(subscribers.withColumnRenamed("subscriber_id", "caller").withColumnRenamed("tower", "home_tower"), "caller")
    kind = F.when(uniform(seed, F.lit("kind"), "event_id") < 0.5, "VOICE").otherwise("SMS")
    cell, blank = S.stable_numeric_id(F.col("tower")), F.lit("")
    columns = {
        "SL_NO": F.col("SL_NO").cast("long") + 1, "Mobile_No": F.col("msisdn"), "Call_Type": kind, "Type_Of_Connec": F.lit("Prepaid"), "Other_Party_No": F.col("receiver"), "LRN_B_Party_No": blank, "LRN_DESCRIPTION": blank,
        "Call_Date": F.date_format("ts", "dd/MM/yyyy"), "Call_Initiation_Time(CIT)": F.date_format("ts", "HH:mm:ss"), "Call_Duration": F.when(kind == "VOICE", F.col("duration")).otherwise(0), "First_Cell_Desc": F.col("tower"), "First_Cell_id": cell,
        "Last_Cell_Desc": F.col("tower"), "Last_Cell_ID": cell, "SMSC_No": F.concat(F.lit("91"), u("smsc", 7000000000, 9999999999)), "Service_Type": kind, "IMEI": F.col("imei"), "IMSI": F.col("imsi"), "Original_Originated_Party": blank,
        "Roaming Circle": F.col("circle"), "MSC_ID": u("msc", 1000000000, 9999999999), "IN_TG": blank, "OUT_TG": blank, "First_LAT": F.round(8 + uniform(seed, F.lit("lat"), "event_id") * 27, 5), "First_Long": F.round(68 + uniform(seed, F.lit("lng"), "event_id") * 29, 5),
        "LRN_LSA": F.col("circle"),
    }
    return j.select(*[c.alias(n) for n, c in columns.items()])


def export_session_schema(sessions: DataFrame, subscribers: DataFrame, seed: int = 7) -> DataFrame:
    """The 31-column session export; dates are written year first, 40 % of the volume goes up. sessions: event_id, subscriber, ts, destination, port, mb."""
    n = lambda what, low, high: (F.lit(low) + F.floor(uniform(seed, F.lit(what), "event_id") * (high - low + 1))).cast("int")
    ip = lambda what, first: F.concat_ws(".", *first, *[n(f"{what}{i}", 0, 255).cast("string") for i in range(4 - len(first))])
    j = sessions.join(subscribers.withColumnRenamed("subscriber_id", "subscriber"), "subscriber")
    minutes, blank = n("minutes", 1, 45), F.lit("")
    end = F.timestamp_seconds(F.unix_seconds("ts") + minutes * 60)
    cell = S.stable_numeric_id(F.col("tower"))
    columns = {
        "Name of Person/Organization": blank, "Address": blank, "Contact No.": blank, "Alternate Contact No.": blank, "E-mail Address": blank, "Landline/MSISDN/MDN/Leased Circuit ID for Internet Access": F.col("msisdn"),
        "User Id for internet Access based on authentication": F.col("subscriber"), "Source IP Address": ip("src", [n("a", 1, 223).cast("string")]), "Source Port": n("sp", 1024, 65535), "Translated IP Address": ip("tr", [F.lit("10")]), "Translated Port": n("tp", 1024, 65535),
        "Destination IP Address": F.col("destination"), "Destination Port": F.col("port").cast("int"), "Static/Dynamic IP Address Allocation": F.lit("Dynamic"), "IST Start Time of Public IP address allocation (hh:mm:ss)": F.date_format("ts", "HH:mm:ss"),
        "IST End Time of Public IP address allocation (hh:mm:ss)": F.date_format(end, "HH:mm:ss"), "Start Date of Public IP Address allocation (dd/mm/yyyy)": F.date_format("ts", "yyyy/MM/dd"), "End Date of Public IP address allocation (dd/mm/yyyy)": F.date_format(end, "yyyy/MM/dd"),
        "Source MAC-ID Address/Other device Identification number": F.col("imei"), "IMSI": F.col("imsi"), "PGW IP address": ip("pgw", [n("p", 1, 223).cast("string")]), "Access Point Name": F.lit("internet"), "First CELL ID": cell, "Last CELL ID": cell,
        "TIME1 (dd/MM/yyyy HH:mm:ss)": F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), "Session Duration (Seconds)": minutes * 60, "Data Volume Up Link": F.floor(F.col("mb") * 1024 * 0.4).cast("int"), "Data Volume Down Link": F.floor(F.col("mb") * 1024 * 0.6).cast("int"),
        "Roaming Circle Indicator": F.lit("HOME"), "Roaming Circle": F.col("circle"), "SIM Type": blank,
    }
    return j.select(*[c.alias(k) for k, c in columns.items()])


