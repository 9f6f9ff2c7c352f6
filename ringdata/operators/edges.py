"""Edges, pair tables and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringdata.functions import scalars as S

from .sweep import near_marks


def distinct_edges(calls: DataFrame, agents: DataFrame) -> DataFrame:
    """Unordered pairs of two different selected agents."""
    lo, hi = S.canonical_pair(F.col("caller"), F.col("receiver"))
    people = agents.select("person").distinct()
    pairs = calls.where("caller <> receiver").select(lo.alias("lo"), hi.alias("hi")).distinct()
    return pairs.join(people.withColumnRenamed("person", "lo"), "lo", "left_semi").join(people.withColumnRenamed("person", "hi"), "hi", "left_semi").select("lo", "hi")


def both_directions(edges: DataFrame) -> DataFrame:
    """node, other: each edge from either end."""
    return edges.select(F.inline(F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")))))


def uniform(seed: int, *cols) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only: 52 bits of an MD5, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(_cells(seed, *cols)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def rank_hash(seed: int, *cols) -> Column:
    """A text to order rows by, in an order that depends on the seed and the columns only."""
    return F.md5(_cells(seed, *cols))


def _cells(seed: int, *cols) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def node_condition(edges: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    """Per node, revealed edges / max(degree, 1); an edge is revealed by its hash."""
    flagged = edges.withColumn("revealed", (uniform(seed, "lo", "hi") < fraction).cast("int"))
    ends = flagged.select(F.inline(F.array(F.struct(F.col("lo").alias("node"), "revealed"), F.struct(F.col("hi").alias("node"), "revealed"))))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("revealed").alias("revealed")).withColumn("condition", F.col("revealed") / F.greatest("degree", F.lit(1)))


def best_score_per_pair(scored: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """A18."""
    return scored.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.max(score).alias("score"))


def label_conflicts(pairs: DataFrame) -> DataFrame:
    """Unordered pairs with more than one label."""
    return pairs.groupBy(F.least("person_a", "person_b").alias("lo"), F.greatest("person_a", "person_b").alias("hi")).agg(F.count_distinct("label").alias("labels")).where("labels > 1")


def pair_violations(pairs: DataFrame) -> DataFrame:
    """person_a, person_b and the reason of every row that must not be trained on."""
    conflicts = label_conflicts(pairs).select("lo", "hi", F.lit(True).alias("conflict"))
    rows = pairs.withColumns({"lo": F.least("person_a", "person_b"), "hi": F.greatest("person_a", "person_b")}).join(conflicts, ["lo", "hi"], "left")
    reason = F.when((F.col("person_a") == "") | (F.col("person_b") == ""), "blank_id").when(F.col("person_a") == F.col("person_b"), "self_pair").when(F.col("conflict"), "label_conflict")
    return rows.select("person_a", "person_b", "label", reason.alias("reason")).where("reason IS NOT NULL")


def prepare_pairs(pairs: DataFrame, labelled: bool) -> DataFrame:
    """Lo, hi, label of valid rows; duplicates are collapsed only where labels are given."""
    bad = pair_violations(pairs).select("person_a", "person_b").distinct()
    good = pairs.join(bad, ["person_a", "person_b"], "left_anti").select(F.least("person_a", "person_b").alias("lo"), F.greatest("person_a", "person_b").alias("hi"), "label")
    return good.distinct() if labelled else good


def attach_endpoint_attributes(edges: DataFrame, subscribers: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of both ends, as <column>_u and <column>_v."""
    out = edges
    for end, key in (("u", "lo"), ("v", "hi")):
        out = out.join(subscribers.select(F.col("subscriber_id").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in columns]), key)
    return out


def merge_edge_sources(observed: DataFrame, inferred: DataFrame) -> DataFrame:
    """Lo, hi, source, is_observed, is_inferred, score (that of the inferred edge)."""
    o, i = observed.select("lo", "hi", F.lit(True).alias("o")), inferred.select("lo", "hi", "score", F.lit(True).alias("i"))
    both = o.join(i, ["lo", "hi"], "full_outer")
    seen, guessed = F.coalesce("o", F.lit(False)), F.coalesce("i", F.lit(False))
    source = F.when(seen & guessed, "observed+inferred").when(seen, "observed").otherwise("inferred")
    return both.select("lo", "hi", source.alias("source"), seen.alias("is_observed"), guessed.alias("is_inferred"), "score")


def agent_friend_edges(edges: DataFrame, subscribers: DataFrame, columns: list[str]) -> DataFrame:
    """Each edge for either end with the other's attributes; unknown ends are dropped."""
    known = subscribers.select(F.col("subscriber_id").alias("agent"))
    other = subscribers.select(F.col("subscriber_id").alias("friend"), *[F.col(c).alias(f"friend_{c}") for c in columns])
    rest = [c for c in edges.columns if c not in ("lo", "hi")]
    ends = edges.select(F.inline(F.array(F.struct(F.col("lo").alias("agent"), F.col("hi").alias("friend"), *rest), F.struct(F.col("hi").alias("agent"), F.col("lo").alias("friend"), *rest))))
    return ends.join(known, "agent").join(other, "friend")


def annotate_contacts(contacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Contacts (agent, other) with the score and source of their edge, and whether there is one."""
    e = edges.select("lo", "hi", F.col("score").alias("edge_score"), F.col("source").alias("edge_source"))
    keyed = contacts.withColumns({"lo": F.least("agent", "other"), "hi": F.greatest("agent", "other")})
    return keyed.join(e, ["lo", "hi"], "left").withColumn("known", F.col("edge_source").isNotNull()).drop("lo", "hi")


def temporal_coincidences(calls: DataFrame, sessions: DataFrame, seconds: int = 300, cap: int | None = None) -> DataFrame:
    """Per pair, the calls with a session of the caller and one of the receiver within `seconds`.

    A sweep join (sweep.near_marks) tells for either end of every call whether a session
    is near, in time linear in both tables, with one person's rows in as many tasks as
    they need. A call is a distinct (event_id, time, caller, receiver). cap keeps the
    first calls by (time, id) where a report asks for it.
    """
    at = sessions.select(F.col("subscriber").alias("person"), F.unix_micros("ts").alias("at"))
    call = calls.where("caller IS NOT NULL AND receiver IS NOT NULL AND ts IS NOT NULL").select("event_id", "caller", "receiver", F.unix_micros("ts").alias("at"))
    ends = call.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("end")).withColumn("person", F.when(F.col("end") == 0, F.col("caller")).otherwise(F.col("receiver")))
    told = near_marks(ends, at, "person", "at", seconds * 1_000_000, order=("event_id", "end"))
    both = [F.bool_or((F.col("end") == k) & F.col("near")) for k in (0, 1)]
    hit = told.groupBy("event_id", "at", "caller", "receiver").agg((both[0] & both[1]).alias("near")).where("near")
    if cap is not None:
        hit = hit.orderBy("at", "event_id").limit(cap)
    return hit.groupBy(F.least("caller", "receiver").alias("lo"), F.greatest("caller", "receiver").alias("hi")).agg(F.count(F.lit(1)).alias("coincidences"))


def exclude_known_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """J16."""
    return candidates.join(edges.select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")


def union_edges(*parts: DataFrame) -> DataFrame:
    """O3."""
    out = parts[0].select("lo", "hi")
    for p in parts[1:]:
        out = out.unionByName(p.select("lo", "hi"))
    return out.distinct()


def union_truth(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and negatives with person_a, person_b, label and its text."""
    tag = lambda df, y: df.withColumn("label", F.lit(y))
    both = tag(positives, 1).unionByName(tag(negatives, 0), allowMissingColumns=True)
    return both.withColumns({"person_a": F.col("lo"), "person_b": F.col("hi"), "truth_label": F.when(F.col("label") == 1, "friend_or_interacting").otherwise("not_friend_or_interacting")})


def order_edges(df: DataFrame) -> DataFrame:
    """Inferred first, then score descending with nulls last, then the ids."""
    return df.orderBy(F.col("is_inferred").desc(), F.col("score").desc_nulls_last(), "lo", "hi")


def numbered(df: DataFrame, order: list, into: str) -> DataFrame:
    """Rows with their number in sort order, from 0.

    Rows are range-partitioned and sorted, counted per partition, and numbered from
    their partition's offset: no global single-partition window.
    """
    from ringdata.sources.tables import stored

    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ids")
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_at") - F.col("_first")
    return rows.join(F.broadcast(offsets), "_part").withColumn(into, number).drop("_part", "_at", "_first", "_offset")


def sequential_ids(df: DataFrame, order: list, prefix: str, width: int = 7, into: str = "row_id") -> DataFrame:
    """PREFIX0000000, ... in sort order."""
    text = F.col("_number").cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return numbered(df, order, "_number").withColumn(into, F.concat(F.lit(prefix), padded)).drop("_number")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """W2."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def top_fraction(df: DataFrame, score: str, fraction: float, n: int | None = None, ties: tuple = ()) -> DataFrame:
    """The int(n * fraction) rows of the highest score; n: all rows unless given."""
    k = int((df.count() if n is None else n) * fraction)
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def paginate(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Page counts from 0."""
    return df.orderBy(*order).offset(page * size).limit(size)


def key_violations(tables: dict[str, DataFrame], primary: dict[str, str], foreign: list[tuple[str, str, str]]) -> DataFrame:
    """Constraint and number of violations: primary keys unique and not null, foreign keys (child, column, parent) present."""
    out = None
    for name, key in primary.items():
        t = tables[name].groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("violations"))
        row = t.select(F.lit(f"pk:{name}.{key}").alias("constraint"), "violations")
        out = row if out is None else out.unionByName(row)
    for child, column, parent in foreign:
        parents = tables[parent].select(F.col(primary[parent]).alias("_key")).distinct()
        lost = tables[child].select(column).join(parents, F.col(column) == F.col("_key"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(lost.select(F.lit(f"fk:{child}.{column}->{parent}").alias("constraint"), "violations"))
    return out
