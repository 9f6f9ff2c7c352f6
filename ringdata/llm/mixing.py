"""Mixing sources to target weights by entropy balancing.

A document's rate is exp(lambda_s * size / mean size of its source), at most
`most` (3). One lambda per source makes the expected words of the source equal its
target: the maximum of the concave dual, found by Newton steps that Spark sums over
the table of (source, size, documents), with bisection as guard. Rates depend only
on source and size, so rounding is done per such stratum: running sums of expected
words along a source's sizes fix how many copies each stratum gives, and its documents
take them evenly, those of the least hash one more. Nothing is random, so reruns
agree, and the order of rows does not matter.
Defined cases: a null text has size 0; a null source is a source, last in order;
sources whose documents are all empty have target 0; repeated rows count each and
may get different copies; an empty table gives an empty result; other columns are
kept by `mix` and dropped by the query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, stored, unused

WEIGHTS = (1, 2, 3)
MOST = 3.0
#: Newton rounds end at this relative residual of every source, or after so many rounds.
TOLERANCE, ROUNDS = 1e-7, 60
#: Documents of a stratum that are ranked together.
RANKED = 256


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ (null: 0)."""
    text = F.coalesce(text, F.lit(""))
    # a word starts at a sign whose predecessor is white space: counted on squeezed text, without building words
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", 0).otherwise(F.regexp_count(plain, F.lit(" ++")) + 1).cast("long")


def source_key(c: Column) -> Column:
    """A key that is never null and sorts by code point, the null source last."""
    return F.when(c.isNull(), "z").otherwise(F.concat(F.lit("s:"), c))


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """skey, source_size and target: shares by weight of all words, none above `most` times its size.

    sizes: skey, source_size, one row a source. Water is filled in the order of
    size / weight: a source is at its limit when the level reaches it.
    """
    order = Window.orderBy("skey")
    k = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "skey")
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("open") / F.col("open_weight")).withColumn("row", F.row_number().over(by_ratio))
    # the level is that of the first source that stays below its limit; sources before it are full
    rows = rows.withColumn("first", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("row", "level"))).over(every))
    full = F.col("first").isNull() | (F.col("row") < F.col("first.row"))
    return rows.select("skey", "source_size", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.col("first.level")).alias("target"))


def rate(lam: Column, scaled: Column, most: float) -> Column:
    return F.exp(F.least(lam * scaled, F.lit(math.log(most))))


def balance(strata: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """skey, size, n, target, source_size and rate of every stratum."""
    means = strata.groupBy("skey").agg(F.greatest(F.sum(F.col("n") * F.col("size")) / F.sum("n"), F.lit(1e-9)).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    state = wanted.join(means, "skey")
    top = F.log(F.lit(most)) * F.col("mean") / F.col("least")  # every rate is at its limit from here on
    state = cut(state.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e6), "high": F.coalesce(top, F.lit(0.0))}))
    strata = cut(strata)
    for _ in range(ROUNDS):
        joined = strata.join(state, "skey").select("skey", "size", "n", "mean", "lam")
        scaled = F.col("size") / F.col("mean")
        w = rate(F.col("lam"), scaled, most)
        sums = joined.groupBy("skey").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("got"),
            F.sum(F.when(F.col("lam") * scaled < math.log(most), F.col("n") * F.col("size") * scaled * w).otherwise(0.0)).alias("slope"),
        )
        gap = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        guarded = F.when((newton > low) & (newton < high), newton).otherwise(F.when(low <= -1e6, 2 * F.col("lam") - 1).otherwise((low + high) / 2))
        done = F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0))
        state = cut(
            state.join(sums, "skey", "left").select(
                "skey", "target", "source_size", "mean", "least", F.when(done, F.col("lam")).otherwise(guarded).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")
            )
        )
        if state.where("NOT done").isEmpty():
            break
    joined = strata.join(state, "skey")
    return joined.select("skey", "size", "n", "target", "source_size", F.coalesce(rate(F.col("lam"), F.col("size") / F.col("mean"), most), F.lit(1.0)).alias("rate"))


def quotas(strata: DataFrame, most: float = MOST) -> DataFrame:
    """strata with `copies`, the copies that a stratum's documents get together.

    Sizes in falling order carry on the words that rounding has left over. A source's
    group has one row per distinct size, so at most sqrt(2 * its words) rows.
    """
    limit = int(most)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("size", ascending=False)
        left, copies = 0.0, []
        for size, n, r in zip(f["size"].tolist(), f["n"].tolist(), f["rate"].tolist(), strict=True):
            want = n * r + (left / size if size else 0.0)
            got = min(max(int(np.floor(want + 0.5)), 0), limit * n)
            left = (want - got) * size if size else left
            copies.append(got)
        return f.assign(copies=copies)

    return strata.groupBy("skey").applyInPandas(run, T.StructType([*strata.schema.fields, T.StructField("copies", T.LongType())]))


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, hash (of the text), size, source_size, target, rate and copies of every row."""
    stratum = ["skey", "size"]
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    rows = stored(rows, "sizes")  # texts are read once
    strata = cut(rows.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")))
    totals = strata.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = cut(quotas(balance(strata, cut(targets(totals, weights, most)), most), most).withColumnRenamed("copies", "quota"))
    # within a stratum: blocks of about RANKED documents by hash; blocks, then documents, take equal shares
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED)).cast("long")
    dealt = rows.join(solved, stratum).withColumn("order", F.xxhash64("doc_id", "hash"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("order", F.lit("block")), blocks))
    # dealt out anew by block, so that the documents of a large stratum do not stay in one task
    dealt = dealt.withColumn("cell", F.concat_ws("/", "block", "size", "skey")).repartition("cell")
    held = dealt.groupBy("cell", *stratum, "block", "n", "quota").agg(F.count(F.lit(1)).alias("in_block"))
    held = held.withColumn("upto", F.sum("in_block").over(Window.partitionBy(*stratum).orderBy("block")))
    share = lambda x: F.floor(F.col("quota") * x / F.col("n"))
    held = held.select("cell", "in_block", (share(F.col("upto")) - share(F.col("upto") - F.col("in_block"))).alias("block_quota"))
    dealt = dealt.join(held, "cell")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("order", "doc_id"))
    base = F.floor(F.col("block_quota") / F.col("in_block"))
    copies = (base + F.when(place <= F.col("block_quota") - base * F.col("in_block"), 1).otherwise(0)).cast("long")
    return dealt.select("doc_id", "source", "hash", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its own columns."""
    i, source, text, copies, times, k = unused(docs.columns, "_id", "_source", "_hash", "_copies", "_rows", "_k")
    taken = plan(docs, weights, most).groupBy(F.col("doc_id").alias(i), F.col("source").alias(source), F.col("hash").alias(text))
    taken = taken.agg(F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).alias(times)).where(F.col(copies) > 0)
    same = docs["doc_id"].eqNullSafe(taken[i]) & docs["source"].eqNullSafe(taken[source]) & (F.xxhash64(docs["text"]) == taken[text])
    rows = docs.join(taken, same)
    # rows that repeat are one row here, taken as often as they are together
    rows = rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([i, source, text]))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(k)).drop(k)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
