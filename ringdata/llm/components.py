"""Connected components of an edge table by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, hot_keys, join_skewed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge.

    Each round sends a node's larger neighbours, then its smaller ones, to its least
    neighbour; the links of a node of very many stay where they are and get its least
    neighbour by broadcast. Rounds end when no edge changes.
    """
    pairs = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    n = F.count(F.lit(1)).alias("n")
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), n))
        large = join_skewed(both.where("v > u"), least.drop("n"), "u", hot_keys(least, "u"))
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), n))
        small = join_skewed(large, least.drop("n"), "u", hot_keys(least, "u"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = cut(small)
        if new.groupBy("u").agg(n).where("n > 1").isEmpty() and new.select(F.col("v").alias("u")).join(new.select("u").distinct(), "u", "left_semi").isEmpty():
            # every node has one link, to a node without one: stars
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        pairs = new
