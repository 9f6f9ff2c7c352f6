"""Per-person and per-pair profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.sources.tables import stored

from .sets import SMALL, columns_of, jaccard_of, set_parts, set_sizes, shared_members

# Names of the pair features, in order, and set members that count as missing.
FEATURES = [
    "cdr_has_direct_interaction", "cdr_events_total", "cdr_direction_min_count", "cdr_direction_max_count", "cdr_reciprocity_ratio", "cdr_direction_balance", "cdr_total_duration_seconds",
    "cdr_mean_duration_seconds", "cdr_max_duration_seconds", "cdr_duration_std_seconds", "cdr_active_days", "cdr_activity_span_days", "cdr_events_per_active_day", "cdr_night_ratio",
    "cdr_weekend_ratio", "cdr_voice_ratio", "cdr_contact_share_min", "cdr_contact_share_max", "cdr_degree_min", "cdr_degree_max", "cdr_common_contacts", "cdr_contact_jaccard",
    "ipdr_both_people_present", "ipdr_session_count_min", "ipdr_session_count_max", "ipdr_session_count_similarity", "ipdr_total_mb_min", "ipdr_total_mb_max", "ipdr_total_mb_similarity",
    "ipdr_mean_session_seconds_similarity", "ipdr_active_days_min", "ipdr_active_days_max", "ipdr_hour_cosine_similarity", "ipdr_destination_jaccard", "ipdr_port_jaccard", "ipdr_cell_jaccard",
    "ipdr_time_bucket_jaccard", "ipdr_night_ratio_similarity", "ipdr_weekend_ratio_similarity",
]
SKIPPED_MEMBERS = ["nan", "none", "null"]


def member(c: Column) -> Column:
    """A set's member: trimmed, in lower case; null if it says that it is missing."""
    t = F.lower(F.trim(F.regexp_replace(c.cast("string"), r"[\s\p{Z}]+", " ")))
    return F.when((t != "") & ~t.isin(SKIPPED_MEMBERS), t)


def _set(c: Column) -> Column:
    return F.array_sort(F.collect_set(member(c)))


def at_least_zero(c: str) -> Column:
    """A measure as a number; missing, not a number or negative counts as 0."""
    return F.greatest(S.safe_number(F.col(c)), F.lit(0.0))


def hours(ts: Column) -> Column:
    """24 counts as an array."""
    return F.array(*[F.count_if(F.hour(ts) == h) for h in range(24)])


def session_profiles(sessions: DataFrame) -> DataFrame:
    """Sessions, sets of destinations, ports and hour buckets, 24-hour histogram of every subscriber."""
    return sessions.where("subscriber <> ''").groupBy(F.col("subscriber").alias("person")).agg(
        F.count(F.lit(1)).alias("sessions"), _set(F.col("destination")).alias("destinations"), _set(F.col("port")).alias("ports"),
        F.array_sort(F.collect_set(F.unix_seconds(S.hour_bucket(F.col("ts"))))).alias("buckets"), hours(F.col("ts")).alias("hours"),
    )


def _day_bit(ts: Column) -> tuple[Column, Column]:
    """A day's block of 64 days, and its bit there: days are counted apart by groups of numbers that hash aggregates hold, not by a row or a set of each."""
    day = F.unix_date(F.to_date(ts))
    return F.shiftright(day, 6), F.call_function("shiftleft", F.lit(1).cast("long"), day.bitwiseAND(63))


def _pair_stats(calls: DataFrame) -> DataFrame:
    """A8, and of every pair the calls and those whose other end is missing."""
    lo, hi = S.canonical_pair(F.col("caller"), F.col("receiver"))
    block, bit = _day_bit(F.col("ts"))
    ts, kind, dur = F.col("ts"), F.coalesce("event_type", F.lit("")), F.col("_dur")
    rows = calls.withColumns({"lo": lo, "hi": hi, "_dur": at_least_zero("duration"), "_block": block, "_bit": bit})
    sums = {
        "d0": F.count_if(F.col("caller") == F.col("lo")), "d1": F.count_if(F.col("caller") != F.col("lo")), "dur": F.sum(dur), "dur2": F.sum(dur * dur), "timed": F.count(ts),
        "night": F.count_if(S.is_night(ts)), "weekend": F.count_if(S.is_weekend(ts)), "typed": F.count_if(kind != ""), "voice": F.count_if(S.is_voice(kind)),
        "calls": F.count(F.lit(1)), "lone": F.count_if(F.col("caller").isNull() | F.col("receiver").isNull()),
    }
    blocks = rows.groupBy("lo", "hi", "_block").agg(*[c.alias(n) for n, c in sums.items()], F.max(dur).alias("dur_max"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.bit_or("_bit").alias("_days"))
    added = lambda *names: [F.sum(n).alias(n) for n in names]
    return blocks.groupBy("lo", "hi").agg(
        *added("d0", "d1", "dur", "dur2"), F.max("dur_max").alias("dur_max"), F.coalesce(F.sum(F.bit_count("_days")), F.lit(0)).alias("days"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *added("timed", "night", "weekend", "typed", "voice", "calls", "lone"),
    )


def call_pair_stats(calls: DataFrame) -> DataFrame:
    """Per unordered pair; d0 counts lo to hi, d1 hi to lo. A missing or negative duration counts as 0."""
    return _pair_stats(calls).drop("calls", "lone")


def _met(stats: DataFrame) -> DataFrame:
    """person, contact and n, how often both_ends has them, from _pair_stats: a call with oneself counts twice, one without an end has a null contact."""
    apart, row = F.col("lo") != F.col("hi"), lambda p, c, n: F.struct(p.alias("person"), c.alias("contact"), n.alias("n"))
    lo, hi, n, lone = F.col("lo"), F.col("hi"), F.col("calls"), F.col("lone")
    ends = F.array(row(lo, hi, F.when(apart, n)), row(hi, lo, F.when(apart, n)), row(lo, lo, F.when(~apart, 2 * (n - lone))), row(lo, F.nullif(lo, lo), F.when(~apart, lone)))
    return stats.select(F.inline(F.filter(ends, lambda r: r["n"] > 0)))


def both_ends(calls: DataFrame) -> DataFrame:
    """person, contact: each call once for either end."""
    return calls.select(F.inline(F.array(F.struct(F.col("caller").alias("person"), F.col("receiver").alias("contact")), F.struct(F.col("receiver").alias("person"), F.col("caller").alias("contact")))))


def call_person_stats(calls: DataFrame) -> DataFrame:
    """Events (a call counts for both ends) and the number of distinct contacts of every person; contact_sets has the contacts."""
    per_contact = both_ends(calls).groupBy("person", "contact").agg(F.count(F.lit(1)).alias("n"))
    return per_contact.groupBy("person").agg(F.sum("n").alias("events"), F.count("contact").alias("contacts"))


def contact_sets(calls: DataFrame) -> DataFrame:
    """Person, part, contacts: distinct contacts in sorted arrays of bounded size."""
    return set_parts(both_ends(calls).where("contact IS NOT NULL"), "person", "contact", "contacts")


def session_person_numbers() -> list[tuple[Column, str]]:
    """Aggregates of A10 that are numbers, with their names; seconds and volume over all sessions, a missing or negative one as 0."""
    ts = F.col("ts")
    return [
        (F.count(F.lit(1)), "sessions"), (F.sum(at_least_zero("mb")), "mb"), (F.sum(at_least_zero("session_s")), "seconds"),
        (F.size(F.collect_set(F.to_date(ts))), "days"), (F.count(ts), "timed"), (hours(ts), "hours"), (F.count_if(S.is_night(ts)), "night"), (F.count_if(S.is_weekend(ts)), "weekend"),
    ]


def session_person_stats(sessions: DataFrame) -> DataFrame:
    """A10: numbers and sets of every subscriber; for people with sets of any size, session_members has them as rows."""
    return sessions.where("subscriber <> ''").groupBy(F.col("subscriber").alias("person")).agg(
        *[c.alias(n) for c, n in session_person_numbers()], _set(F.col("destination")).alias("destinations"), _set(F.col("port")).alias("ports"), _set(F.col("cell")).alias("cells"), F.array_sort(F.collect_set(F.unix_seconds(S.hour_bucket(F.col("ts"))))).alias("buckets"),
    )


SETS = ["contacts", "destinations", "ports", "cells", "buckets"]


#: Distinct values of a kind up to whose number its members are numbered, so that sets hold numbers of two bytes at most.
CODES = 65_536
#: People of asked pairs up to whose number events are cut down to them before they are summed.
CUT_PEOPLE = 200_000


def _session_values() -> dict[str, Column]:
    """What a session holds of each kind, as text."""
    return {"destinations": F.col("destination").cast("string"), "ports": F.col("port").cast("string"), "cells": F.col("cell").cast("string"), "buckets": F.unix_seconds(S.hour_bucket(F.col("ts"))).cast("string")}


def _session_members() -> dict[str, Column]:
    """The members of each kind that a session has."""
    return {k: v if k == "buckets" else member(v) for k, v in _session_values().items()}


def person_members(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """person, kind (one of SETS), member: the sets of A9 and A10 as distinct rows."""
    met = both_ends(calls).select("person", F.lit("contacts").alias("kind"), F.col("contact").alias("member"))
    return met.where("member IS NOT NULL").distinct().unionByName(session_members(sessions))


def session_members(sessions: DataFrame) -> DataFrame:
    """person_members without contacts."""
    own = sessions.where("subscriber <> ''").select(F.col("subscriber").alias("person"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), m.alias("member")) for k, m in _session_members().items()])))
    return own.where("member IS NOT NULL").distinct()


def _coded(own: DataFrame) -> DataFrame:
    """Sessions with <kind>_code for each kind of _session_members: what the arrays of sets hold of a session's member.

    Of a kind with up to CODES distinct values it is the member's number in order, in one
    byte or two, and members are read once a value; of any other a 64-bit hash (buckets:
    the hour itself).
    """
    kinds = _session_values()
    named = own.withColumns({f"_{k}": v for k, v in kinds.items()})
    values = named.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("value")) for k in kinds])))
    values = stored(values.where("value IS NOT NULL").distinct(), "values")
    counts = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a kind
    number = F.dense_rank().over(Window.orderBy("member"))
    for k in kinds:
        n, own_member = counts.get(k, 0), lambda c: c if k == "buckets" else member(c)  # noqa: B023, E731
        if n > CODES:
            named = named.withColumn(f"{k}_code", F.unix_seconds(S.hour_bucket(F.col("ts"))) if k == "buckets" else _hashed(member(F.col(f"_{k}"))))
            continue
        code = (number - 129).cast("byte") if n <= 256 else (number - 32_769).cast("short")
        known = values.where(F.col("kind") == k).select(F.col("value").alias(f"_{k}"), own_member(F.col("value")).alias("member")).where("member IS NOT NULL").select(f"_{k}", code.alias(f"{k}_code"))  # up to CODES rows
        named = named.join(F.broadcast(known), f"_{k}", "left")
    return named.drop(*[f"_{k}" for k in kinds])


def _hashed(m: Column) -> Column:
    return F.when(m.isNotNull(), F.xxhash64(m))


def _size(codes: Column) -> Column:
    """Members of a set; of none, 0."""
    return F.greatest(F.coalesce(F.size(codes), F.lit(0)), F.lit(0)).cast("long")  # the size of null is null or -1


def _cut(df: DataFrame, people: DataFrame, key: str, few: bool) -> DataFrame:
    """The rows of people, if these are few."""
    return df.join(F.broadcast(people.withColumnRenamed("person", key)), key, "left_semi") if few else df


def _cut_calls(calls: DataFrame, people: DataFrame, few: bool) -> DataFrame:
    """The calls with an end among people, if these are few."""
    if not few:
        return calls
    known = lambda key: F.broadcast(people.select(F.col("person").alias(f"_{key}")))
    ends = calls.join(known("caller"), F.col("caller") == F.col("_caller"), "left").join(known("receiver"), F.col("receiver") == F.col("_receiver"), "left")
    return ends.where("_caller IS NOT NULL OR _receiver IS NOT NULL").drop("_caller", "_receiver")


def person_profiles(people: DataFrame, stats: DataFrame, sessions: DataFrame, few: bool) -> tuple[DataFrame, DataFrame | None]:
    """The numbers and sets of every one of people, and who is large (nobody: None); stats: _pair_stats of their calls at least.

    A row has person, events, s_* (A10's numbers) and, for each of SETS, <kind>_set with
    numbers of the members (_coded; contacts: 64-bit hashes) and <kind>_size. A person with more than SMALL contacts or sessions is large: the sets are
    null and sizes come from their members' rows, so that no row grows beyond SMALL members
    of a kind.
    """
    own = _cut(sessions.where("subscriber <> ''"), people, "subscriber", few).withColumnRenamed("subscriber", "person")
    met = _cut(_met(stats), people, "person", few)
    counts = [met.groupBy("person").agg(F.count("contact").alias("n")), own.groupBy("person").agg(F.count(F.lit(1)).alias("n"))]
    large = stored(counts[0].unionByName(counts[1]).where(F.col("n") > SMALL).select("person").distinct(), "large")
    none = large.isEmpty()
    # at most one of SMALL calls' ends or sessions
    flagged = lambda df: df.withColumn("_large", F.lit(False)) if none else df.join(F.broadcast(large.withColumn("_large", F.lit(True))), "person", "left").withColumn("_large", F.coalesce("_large", F.lit(False)))
    set_of = lambda c: F.collect_set(F.when(~F.col("_large"), c))
    near = flagged(met).groupBy("person").agg(F.sum("n").alias("events"), set_of(_hashed(F.col("contact"))).alias("contacts_set"))
    use = flagged(_coded(own)).groupBy("person").agg(*[c.alias(f"s_{n}") for c, n in session_person_numbers()], *[set_of(F.col(f"{k}_code")).alias(f"{k}_set") for k in _session_members()]).withColumn("buckets_set", F.sort_array("buckets_set"))
    prof = people.join(near, "person", "left").join(use, "person", "left")
    if none:
        return prof.withColumns({f"{k}_size": _size(F.col(f"{k}_set")) for k in SETS}), None
    hubs = lambda df, key: df.join(F.broadcast(large.withColumnRenamed("person", key)), key, "left_semi")
    rows = hubs(met.where("contact IS NOT NULL").select("person", F.lit("contacts").alias("kind"), F.col("contact").alias("member")), "person").unionByName(hubs(session_members(sessions), "person"))
    sizes = columns_of(set_sizes(rows), ["person"], SETS, ["size"]).withColumn("_hub", F.lit(True))
    prof = prof.join(sizes.withColumnsRenamed({f"{k}_size": f"_{k}" for k in SETS}), "person", "left")
    hub = F.coalesce("_hub", F.lit(False))
    prof = prof.withColumns({f"{k}_size": F.when(hub, F.col(f"_{k}")).otherwise(_size(F.col(f"{k}_set"))) for k in SETS} | {f"{k}_set": F.when(~hub, F.col(f"{k}_set")) for k in SETS})
    return prof.drop("_hub", *[f"_{k}" for k in SETS]), large


def attach_pair_events(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls whose ends are a requested pair, with direction 0 (lo to hi) or 1."""
    lo, hi = S.canonical_pair(F.col("caller"), F.col("receiver"))
    tagged = calls.withColumns({"lo": lo, "hi": hi}).withColumn("direction", (F.col("caller") != F.col("lo")).cast("int"))
    return tagged.join(pairs.select("lo", "hi").distinct(), ["lo", "hi"], "left_semi")


def attach_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs with a_* and b_* columns of both ends' profiles, null where there is none."""
    out = pairs
    for side, key in (("a", "lo"), ("b", "hi")):
        named = profiles.select(*[F.col(c).alias(f"{side}_{c}") for c in profiles.columns])
        out = out.join(named, F.col(key) == F.col(f"{side}_person"), "left").drop(f"{side}_person")
    return out


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def pair_features(pairs: DataFrame, calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """K2: lo, hi and the 39 FEATURES of every row of pairs.

    People's numbers and sets meet in one join for each end, sets of up to SMALL members as
    arrays of 64-bit hashes; pairs with a larger one are counted by rows (sets.shared_members).
    """
    pairs = stored(pairs.select("lo", "hi"), "pairs")
    people = stored(pairs.select(F.explode(F.array("lo", "hi")).alias("person")).distinct(), "people")
    few = people.limit(CUT_PEOPLE + 1).count() <= CUT_PEOPLE
    # one pass over the calls gives the pairs' numbers and the people's contacts
    stats = stored(_pair_stats(_cut_calls(calls, people, few)), "stats")
    prof, large = person_profiles(people, stats, sessions, few)
    both = attach_profiles(pairs.join(stats, ["lo", "hi"], "left"), stored(prof, "profiles"))
    both = both.withColumns({f"{k}_shared": _size(F.array_intersect(f"a_{k}_set", f"b_{k}_set")) for k in SETS}).drop(*[f"{s}_{k}_set" for s in "ab" for k in SETS])
    if large is not None:
        touched = stored(pairs.join(F.broadcast(large.withColumnRenamed("person", "lo")), "lo", "left_semi").unionByName(pairs.join(F.broadcast(large.withColumnRenamed("person", "hi")), "hi", "left_semi")).distinct(), "touched")
        ends = touched.select(F.explode(F.array("lo", "hi")).alias("person")).distinct()
        members = stored(person_members(calls, sessions).join(ends, "person", "left_semi"), "members")
        counted = columns_of(shared_members(touched, members), ["lo", "hi"], SETS, ["shared"]).withColumnsRenamed({f"{k}_shared": f"_{k}" for k in SETS})
        both = both.join(counted, ["lo", "hi"], "left").withColumns({f"{k}_shared": F.coalesce(f"_{k}", f"{k}_shared") for k in SETS}).drop(*[f"_{k}" for k in SETS])
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    alike_sets = lambda k: jaccard_of(n(f"{k}_shared"), n(f"a_{k}_size"), n(f"b_{k}_size"))
    low, high = lambda c: F.least(n(f"a_{c}"), n(f"b_{c}")), lambda c: F.greatest(n(f"a_{c}"), n(f"b_{c}"))
    alike = lambda c: S.ratio_similarity(n(f"a_{c}"), n(f"b_{c}"))
    total = n("d0") + n("d1")
    mean = _ratio(n("dur"), total)
    span = F.coalesce((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 86_400e6, F.lit(0.0))
    share_a, share_b = _ratio(total, n("a_events")), _ratio(total, n("b_events"))
    present = (n("a_s_sessions") > 0) & (n("b_s_sessions") > 0)
    secs = lambda s: _ratio(n(f"{s}_s_seconds"), n(f"{s}_s_sessions"))
    zeros = F.array(*[F.lit(0).cast("bigint")] * 24)
    hist = lambda s: F.coalesce(F.col(f"{s}_s_hours"), zeros)
    timed = (n("a_s_timed") > 0) & (n("b_s_timed") > 0)
    part = lambda c: F.when(timed, 1 - F.abs(_ratio(n(f"a_s_{c}"), n("a_s_timed")) - _ratio(n(f"b_s_{c}"), n("b_s_timed")))).otherwise(0.0)
    values = [
        (total > 0).cast("double"), total, F.least(n("d0"), n("d1")), F.greatest(n("d0"), n("d1")), _ratio(2 * F.least(n("d0"), n("d1")), total), _ratio(F.abs(n("d0") - n("d1")), total), n("dur"), mean,
        n("dur_max"), F.sqrt(F.greatest(_ratio(n("dur2"), total) - mean * mean, F.lit(0.0))), n("days"), span, _ratio(total, n("days")), _ratio(n("night"), n("timed")), _ratio(n("weekend"), n("timed")),
        _ratio(n("voice"), n("typed")), F.least(share_a, share_b), F.greatest(share_a, share_b), low("contacts_size"), high("contacts_size"),
        n("contacts_shared"), alike_sets("contacts"), present.cast("double"), low("s_sessions"), high("s_sessions"), alike("s_sessions"), low("s_mb"), high("s_mb"), alike("s_mb"),
        S.ratio_similarity(secs("a"), secs("b")), low("s_days"), high("s_days"), S.cosine(hist("a"), hist("b")), alike_sets("destinations"),
        alike_sets("ports"), alike_sets("cells"), alike_sets("buckets"), part("night"), part("weekend"),
    ]
    return both.select("lo", "hi", *[v.alias(name) for name, v in zip(FEATURES, values, strict=True)])


def pair_coverage(features: DataFrame) -> DataFrame:
    """A25."""
    return features.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("cdr_has_direct_interaction") > 0).alias("with_calls"), F.count_if(F.col("ipdr_both_people_present") > 0).alias("with_sessions"))


def hourly_rate_pattern(events: DataFrame, n_edges: int) -> DataFrame:
    """24 multipliers (count / mean) and the base rate per edge and hour; no rows if there are no events or edges."""
    hours_ = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    span = events.agg(F.count(F.lit(1)).alias("total"), F.greatest((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400e6, F.lit(1.0)).alias("days")).where(F.lit(n_edges > 0) & (F.col("total") > 0))
    out = hours_.join(counts, "hour", "left").join(F.broadcast(span), F.lit(True))  # span is one row
    n = F.coalesce("n", F.lit(0))
    return out.select("hour", (n * 24 / F.col("total")).alias("multiplier"), (F.col("total") / (F.lit(max(n_edges, 1)) * F.col("days") * 24)).alias("base_rate"))


def value_weights(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of values and their shares within a key."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return counts.join(totals, key).select(key, value, "n", (F.col("n") / F.col("total")).alias("weight"))


def call_behaviour(calls: DataFrame, agents: DataFrame) -> DataFrame:
    """Per agent: calls, distinct hours and durations, selected contacts and the share of calls to them; agents without calls get 0 and the global counts."""
    chosen = agents.select(F.col("person").alias("agent")).distinct()
    inside = chosen.select(F.col("agent").alias("receiver"), F.lit(1).alias("known"))
    own = calls.join(chosen.withColumnRenamed("agent", "caller"), "caller", "left_semi").join(inside, "receiver", "left")
    per = own.groupBy(F.col("caller").alias("agent")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct(F.hour("ts")).alias("n_hours"), F.count_distinct("duration").alias("n_durations"),
        F.count_distinct(F.when(F.col("known") == 1, F.col("receiver"))).alias("contacts"),
    )
    world = calls.agg(F.count_distinct(F.hour("ts")).alias("g_hours"), F.count_distinct("duration").alias("g_durations"))
    out = chosen.join(per, "agent", "left").join(F.broadcast(world), F.lit(True))  # world is one row
    return out.select(
        "agent", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("n_hours", "g_hours").alias("n_hours"), F.coalesce("n_durations", "g_durations").alias("n_durations"),
        F.coalesce("contacts", F.lit(0)).alias("contacts"), (F.coalesce("contacts", F.lit(0)) / F.greatest(F.coalesce("calls", F.lit(0)), F.lit(1))).alias("share"),
    )


# The neutral session profile, and the default ports with their weights.
NEUTRAL = {"n_hours": 24, "n_destinations": 4, "mb": 5.0}
PORTS = [443, 80, 53, 8080, 8443, 123, 22, 3478, 5222, 5223, 5228, 5242, 993, 995, 25, 5060]
PORT_WEIGHTS = [0.522, 0.12, 0.09, 0.035, 0.025, 0.025, 0.02, 0.02, 0.04, 0.02, 0.02, 0.02, 0.015, 0.008, 0.005, 0.015]


def session_behaviour(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """Per agent: hours, destinations, mean volume, ports; an agent without sessions gets the neutral profile, never another's."""
    per = sessions.groupBy(F.col("subscriber").alias("agent")).agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct(F.hour("ts")).alias("n_hours"), F.count_distinct("destination").alias("n_destinations"), F.avg("mb").alias("mb"), F.count_distinct("port").alias("n_ports"))
    out = agents.select(F.col("person").alias("agent")).distinct().join(per, "agent", "left")
    return out.select(
        "agent", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("n_hours", F.lit(NEUTRAL["n_hours"])).alias("n_hours"), F.coalesce("n_destinations", F.lit(NEUTRAL["n_destinations"])).alias("n_destinations"),
        F.coalesce("mb", F.lit(NEUTRAL["mb"])).alias("mb"), F.coalesce("n_ports", F.lit(len(PORTS))).alias("n_ports"), F.col("sessions").isNull().alias("neutral"),
    )


def activity_ranking(calls: DataFrame, person: str = "caller") -> DataFrame:
    """People by (-calls, id)."""
    return calls.groupBy(F.col(person).alias("person")).agg(F.count(F.lit(1)).alias("calls")).orderBy(F.col("calls").desc(), "person")
