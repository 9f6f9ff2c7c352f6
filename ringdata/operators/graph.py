"""Graph measures over edge tables (G1-G5, W11); iterations cut their lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringdata.operators.edges import both_directions
from ringdata.sources.tables import cut

#: Steps of the power iteration between two checkpoints.
STEPS = 5


def evidence_graph(pairs: DataFrame, threshold: float = 0.40, p: str = "p") -> DataFrame:
    """G1: lo, hi, p of pairs at or above the threshold, one row a pair."""
    return pairs.where((F.col(p) >= threshold) & (F.col("lo") != F.col("hi"))).groupBy("lo", "hi").agg(F.max(p).alias("p"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Node, degree, centrality = degree / (N - 1)."""
    deg = both_directions(edges.select("lo", "hi").distinct()).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = deg.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("rest"))
    return deg.join(F.broadcast(n), F.lit(True)).select("node", "degree", (F.col("degree") / F.col("rest")).alias("centrality"))  # n is one row


def eigenvector_centrality(edges: DataFrame, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """Node, centrality: power iteration on A + I (which also settles on bipartite graphs), L2 norm 1, at most `rounds` rounds.

    A round is one aggregation over the edges; sums of a node of very many links are
    combined before the shuffle.
    """
    ends = cut(both_directions(edges.select("lo", "hi").distinct()))
    v = ends.select("node").distinct().withColumn("x", F.lit(1.0))
    for first in range(0, rounds, STEPS):
        v = cut(v)
        new = v.withColumnRenamed("x", "y")
        for _ in range(min(STEPS, rounds - first)):  # unscaled steps between two cuts
            sums = ends.join(new.select(F.col("node").alias("other"), F.col("y").alias("z")), "other").groupBy("node").agg(F.sum("z").alias("s"))
            new = new.join(sums, "node").select("node", (F.col("y") + F.col("s")).alias("y"))
        new = cut(new.join(v, "node"))
        norm = new.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0]
        if not norm:
            break
        v = new.select("node", (F.col("y") / norm).alias("x"))
        if (new.agg(F.max(F.abs(F.col("y") / norm - F.col("x")))).first()[0] or 0.0) < tolerance:
            break
    return v.select("node", F.col("x").alias("centrality"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Node, community by synchronous label propagation: the label most neighbours (and the node itself) have, ties to the smallest; at most `rounds` rounds."""
    ends = both_directions(edges.select("lo", "hi").distinct())
    votes = cut(ends.unionByName(ends.select("node").distinct().select("node", F.col("node").alias("other"))))
    labels = cut(votes.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        counts = votes.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("o"), "label")).alias("b")).select("node", F.col("b.label").alias("new"))
        step = cut(labels.join(best, "node"))
        changed = not step.where("new <> label").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            break
    return labels.select("node", F.col("label").alias("community"))


def community_summary(labels: DataFrame, edges: DataFrame, centrality: DataFrame, weight: str = "p") -> DataFrame:
    """Size, mean weight of inner edges and the most central member (ties: the smaller id) of every community."""
    a, b = labels.select(F.col("node").alias("lo"), F.col("community").alias("ca")), labels.select(F.col("node").alias("hi"), F.col("community").alias("cb"))
    inner = edges.join(a, "lo").join(b, "hi").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.avg(weight).alias("inner_mean"), F.count(F.lit(1)).alias("inner_edges"))
    size = labels.join(centrality, "node").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("centrality")).alias("o"), "node")).alias("b"))
    return size.join(inner, "community", "left").select("community", "size", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), "inner_mean", F.col("b.node").alias("leader"))


def top_nodes(measures: DataFrame, columns: list[str], k: int = 8) -> DataFrame:
    """The k nodes of the highest mean of the measures, each scaled to its maximum."""
    top = measures.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    scaled = [F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0) for c in columns]
    total = sum(scaled[1:], scaled[0]) / len(columns)
    return measures.join(F.broadcast(top), F.lit(True)).select("node", F.round(total, 9).alias("composite")).orderBy(F.col("composite").desc(), "node").limit(k)  # top is one row

