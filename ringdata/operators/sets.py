"""Sets of any size as rows: sizes, intersections for asked pairs, and bounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of one part of a set that is written as arrays.
PART = 65_536
#: Members of a set that a pair's row may carry.
SMALL = 4_096


def set_sizes(members: DataFrame) -> DataFrame:
    """person, kind, size; members: distinct (person, kind, member)."""
    return members.groupBy("person", "kind").agg(F.count(F.lit(1)).alias("size"))


def shared_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """lo, hi, kind, size_lo, size_hi, shared for each distinct pair and kind that both ends have a set of.

    Sets of up to SMALL members travel as arrays of 64-bit hashes, once for each pair. Where
    one of the two is larger, no set is carried on a pair's row: the members of the smaller
    set are looked up among those of the larger one by an equi-join on (person, kind,
    member), so that a pair costs as many rows as its smaller set has members: a person with
    a million members, asked for with a million others, costs what the others hold. Rows of
    one person that are many are a skewed join, which adaptive execution splits.
    """
    asked, sizes = pairs.select("lo", "hi").distinct(), set_sizes(members)
    large = sizes.where(F.col("size") > SMALL).select("person", "kind")
    small = members.join(large, ["person", "kind"], "left_anti").select("person", "kind", F.xxhash64("member").alias("member")).repartition("person")
    sets = small.groupBy("person", "kind").agg(F.collect_list("member").alias("set")).groupBy("person").agg(F.collect_list(F.struct("kind", "set")).alias("sets"))
    own = lambda s: sets.select(F.col("person").alias(s), F.col("sets").alias(f"sets_{s}"))
    one = lambda x, y: F.struct(x["kind"].alias("kind"), F.size(x["set"]).cast("long").alias("size_lo"), F.size(y["set"]).cast("long").alias("size_hi"), F.size(F.array_intersect(x["set"], y["set"])).cast("long").alias("shared"))
    kinds = F.flatten(F.transform("sets_lo", lambda x: F.transform(F.filter("sets_hi", lambda y: x["kind"] == y["kind"]), lambda y: one(x, y))))
    carried = asked.join(own("lo"), "lo").join(own("hi"), "hi").select("lo", "hi", F.inline(kinds))

    touched = [asked.join(large.withColumnRenamed("person", end), end).select("lo", "hi", "kind") for end in ("lo", "hi")]
    side = lambda s: sizes.select(F.col("person").alias(s), "kind", F.col("size").alias(f"size_{s}"))
    sized = touched[0].unionByName(touched[1]).distinct().join(side("lo"), ["lo", "kind"]).join(side("hi"), ["hi", "kind"])
    smaller = F.col("size_lo") <= F.col("size_hi")
    ask = sized.select("lo", "hi", "kind", F.when(smaller, F.col("lo")).otherwise(F.col("hi")).alias("person"), F.when(smaller, F.col("hi")).otherwise(F.col("lo")).alias("other"))
    probe = ask.join(members, ["person", "kind"]).select("lo", "hi", "kind", F.col("other").alias("person"), "member")
    shared = probe.join(members, ["person", "kind", "member"], "left_semi").groupBy("lo", "hi", "kind").agg(F.count(F.lit(1)).alias("shared"))
    looked = sized.join(shared, ["lo", "hi", "kind"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return carried.unionByName(looked.select(*carried.columns))


def columns_of(rows: DataFrame, keys: list[str], kinds: list[str], values: list[str]) -> DataFrame:
    """One row of `rows` (keys, kind, values) for each keys: a column kind_value for every kind and value, null where there is none."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col(v))).alias(f"{k}_{v}") for k in kinds for v in values])


def jaccard_of(shared: Column, a: Column, b: Column) -> Column:
    """F12 of two sets by their sizes; 0 when both are empty."""
    return F.when(a + b > 0, shared / (a + b - shared)).otherwise(0.0)


def set_parts(rows: DataFrame, key: str, member: str, into: str, part: int = PART) -> DataFrame:
    """key, part, into: the distinct members of every key in sorted arrays of about `part` members at most.

    A key with more members than that has several parts, by a hash of the member. Only
    such keys are looked up, so members of all others stay where they are.
    """
    distinct = rows.select(key, member).distinct()
    large = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part).select(F.col(key).alias("_large"), F.ceil(F.col("_n") / part).cast("int").alias("_parts"))
    numbered = distinct.join(large, F.col(key).eqNullSafe(F.col("_large")), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(member), "_parts").cast("int"), F.lit(0)))
    return numbered.groupBy(key, "part").agg(F.array_sort(F.collect_list(member)).alias(into))
