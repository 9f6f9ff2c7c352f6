"""Order statistics of any number of rows: exact ranks by histograms, running sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringdata.sources.tables import stored

#: Bits that one pass over the values settles.
DIGIT = 16


def values_at_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str], value: str = "value", weight: str = "n", rank: str = "rank") -> DataFrame:
    """keys, rank, value: the value that stands at a rank (from 1) of each key's values in ascending order; exact.

    rows: keys, value (long) and weight (how often it counts). ranks: distinct (keys,
    rank), each between 1 and the key's sum of weights. The bits that all values share
    are settled at once; each pass counts the values by their next DIGIT bits among those
    whose higher bits are settled, with partial sums, and settles the bits in which the
    rank falls. A pass has at most 2 ** DIGIT counts for a key and rank, whatever the
    number of rows.
    """
    bits = F.col(value).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.select(*keys, F.lit(None).cast("long").alias(rank), value).limit(0)
    shared = 64 - ((low + (1 << 63)) ^ (high + (1 << 63))).bit_length()
    prefix = ((low + (1 << 63)) >> (64 - shared)) if shared else 0
    asked = [f"_{k}" for k in keys]
    open_ = stored(ranks.select(*[F.col(k).alias(a) for k, a in zip(keys, asked, strict=True)], F.col(rank).alias("_asked"), F.col(rank).alias("_left"), F.lit(prefix - (prefix >> 63 << 64)).cast("long").alias("_prefix")), "ranks")
    same = lambda rows_: [rows_[k].eqNullSafe(F.col(a)) for k, a in zip(keys, asked, strict=True)]
    for done in range(shared, 64, DIGIT):
        width = min(DIGIT, 64 - done)
        digit = F.shiftrightunsigned(bits, 64 - done - width).bitwiseAND(F.lit((1 << width) - 1))
        higher = F.shiftrightunsigned(bits, 64 - done) if done else F.lit(0).cast("long")
        counted = rows.groupBy(*keys, higher.alias("_higher"), digit.alias("_digit")).agg(F.sum(weight).alias("_n"))
        met = open_.join(counted, [*same(counted), F.col("_higher") == F.col("_prefix")])
        over = Window.partitionBy(*asked, "_asked").orderBy("_digit")  # at most 2 ** DIGIT rows
        upto = met.withColumn("_upto", F.sum("_n").over(over)).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        prefix = F.shiftleft("_prefix", width).bitwiseOR(F.col("_digit"))
        open_ = stored(upto.select(*asked, "_asked", (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), prefix.alias("_prefix")), "ranks")
    return open_.select(*[F.col(a).alias(k) for k, a in zip(keys, asked, strict=True)], F.col("_asked").alias(rank), F.col("_prefix").bitwiseXOR(F.lit(-(1 << 63))).alias(value))


def quantile(rows: DataFrame, value: Column, q: float) -> DataFrame:
    """One row, `q`: the smallest value with at least a share q of all values at or below it (null: no values); nulls do not count."""
    some = rows.select(value.cast("long").alias("value"), F.lit(1).alias("n")).where("value IS NOT NULL")
    # the share is taken off from above, as a database's discrete quantile does, so that rounding agrees
    ranks = some.agg(F.count(F.lit(1)).alias("rows")).where("rows > 0").select(F.greatest(F.lit(1), F.col("rows") - F.floor(F.col("rows") - q * F.col("rows"))).alias("rank"))
    return values_at_ranks(some, ranks, []).agg(F.max("value").alias("q"))


def medians(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, low, high: the weighted lower and upper median of the values (long) of every key; they are one for odd weights."""
    total = rows.groupBy(*keys).agg(F.sum(weight).alias("_n"))
    ranks = total.where("_n > 0").select(*keys, F.explode(F.array_distinct(F.expr("array((_n + 1) div 2, (_n + 2) div 2)"))).alias("rank"))
    found = values_at_ranks(rows, ranks, keys, value, weight)
    return found.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def running_sums(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """rows with before_<c> for each of sums: the sum of c over all rows that stand earlier.

    Rows are dealt by ranges of the order and sums are taken within a range; each range
    starts from the sums of those before it (a table with a row for each range). No two
    rows may tie, so that every order gives the same sums.
    """
    dealt = stored(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")), "ranges")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_of_{c}") for c in sums])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_from_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(starts), "_part")
    return joined.select(*rows.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_from_{c}")).alias(f"before_{c}") for c in sums])
