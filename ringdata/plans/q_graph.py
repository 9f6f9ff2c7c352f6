"""Queries: graph measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringdata.operators import graph as G
from ringdata.plans.q_pairs import q6, r6
from ringdata.plans.registry import query
from ringdata.sources import views as V

EDGES = ", g AS (SELECT lo, hi, score AS p FROM inferred WHERE score >= 0.4), b AS (SELECT lo AS node, hi AS other FROM g UNION ALL SELECT hi, lo FROM g), deg AS (SELECT node, count(*) AS degree FROM b GROUP BY 1)"


def _graph(spark, d):
    return G.evidence_graph(V.inferred(spark, d).withColumnRenamed("score", "p"))


@query("g1_evidence_graph", EDGES + "SELECT * FROM g")
def g1(spark, d):
    return _graph(spark, d)


@query("g2_degree_centrality", EDGES + "SELECT node, degree, " + q6("degree / greatest((SELECT count(*) FROM deg) - 1, 1)::DOUBLE", "centrality") + " FROM deg")
def g2(spark, d):
    return G.degree_centrality(_graph(spark, d)).select("node", "degree", r6(F.col("centrality"), "centrality"))


def _propagated(rounds=20):
    """Label propagation, round by round; a round after the last change changes nothing."""
    parts = [", v AS (SELECT node, other FROM b UNION ALL SELECT DISTINCT node, node FROM b), l0 AS (SELECT DISTINCT node, node AS label FROM b)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT v.node, label FROM v JOIN l{i} l ON l.node = v.other GROUP BY v.node, label QUALIFY row_number() OVER (PARTITION BY v.node ORDER BY count(*) DESC, label) = 1)")
    return ", ".join([*parts, f"labels_ AS (SELECT node, label AS community FROM l{rounds})"])


def _power(rounds=50, tolerance=1e-6):
    """Power iteration, scaled every STEPS rounds, until a stretch changes less than the tolerance."""
    parts = [", x0 AS (SELECT DISTINCT node, 1.0::DOUBLE AS x, false AS done FROM b)"]
    for i in range(rounds // G.STEPS):
        parts.append(f"y{i}_0 AS (SELECT node, x AS y FROM x{i})")
        for j in range(G.STEPS):
            parts.append(f"y{i}_{j + 1} AS MATERIALIZED (SELECT a.node, any_value(a.y) + sum(o.y) AS y FROM y{i}_{j} a JOIN b ON b.node = a.node JOIN y{i}_{j} o ON o.node = b.other GROUP BY 1)")
        last = f"y{i}_{G.STEPS}"
        parts.append(f"z{i} AS MATERIALIZED (SELECT node, y / sqrt((SELECT sum(y * y) FROM {last})) AS z FROM {last})")
        parts.append(f"x{i + 1} AS MATERIALIZED (SELECT node, CASE WHEN done THEN x ELSE z END AS x, done OR (max(abs(z - x)) OVER ()) < {tolerance} AS done FROM x{i} JOIN z{i} USING (node))")
    return ", ".join([*parts, f"power AS (SELECT node, x FROM x{rounds // G.STEPS})"])


@query("g3_eigenvector_centrality", EDGES + _power() + "SELECT node, " + q6("x", "centrality") + " FROM power")
def g3(spark, d):
    return G.eigenvector_centrality(_graph(spark, d)).select("node", r6(F.col("centrality"), "centrality"))


@query("g4_communities", EDGES + _propagated() + "SELECT * FROM labels_")
def g4(spark, d):
    return G.communities(_graph(spark, d))


@query("g5_community_summary", EDGES + _propagated() + """, i AS (SELECT l.community, count(*) AS n, avg(p) AS m FROM g JOIN labels_ l ON l.node = lo JOIN labels_ h ON h.node = hi WHERE l.community = h.community GROUP BY 1),
s AS (SELECT community, count(*) AS size, arg_min(node, (-degree, node)) AS leader FROM labels_ JOIN deg USING (node) GROUP BY 1) SELECT community, size, coalesce(n, 0) AS inner_edges, """ + q6("m", "inner_mean") + ", leader FROM s LEFT JOIN i USING (community)")
def g5(spark, d):
    e = _graph(spark, d)
    s = G.community_summary(G.communities(e), e, G.degree_centrality(e))
    return s.select("community", "size", "inner_edges", r6(F.col("inner_mean"), "inner_mean"), "leader")


@query("w11_top_nodes", EDGES + "SELECT node, round(degree / (SELECT max(degree) FROM deg)::DOUBLE, 9) AS composite FROM deg ORDER BY composite DESC, node LIMIT 8")
def w11(spark, d):
    return G.top_nodes(G.degree_centrality(_graph(spark, d)), ["degree", "centrality"])
