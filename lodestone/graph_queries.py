"""Registered queries of ranking on the graph of links, each beside its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph
from .queries import EDGES, SQL, edges, query, table

NODES = "nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY src)"
_STEP = "SELECT nd.node, CASE WHEN nd.node < 10 THEN 0.15::DOUBLE / 10 ELSE 0 END + 0.85::DOUBLE * (coalesce(g.got, 0) + CASE WHEN nd.node < 10 THEN (SELECT coalesce(sum(score), 0) FROM {p} WHERE node NOT IN (SELECT src FROM o)) / 10 ELSE 0 END) AS score FROM nd LEFT JOIN (SELECT dst AS node, sum({p}.score / o.n) AS got FROM e JOIN {p} ON {p}.node = e.src JOIN o ON o.src = e.src GROUP BY dst) g USING (node)"
PERSONAL = f"WITH {EDGES}, {NODES}, r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd), r1 AS ({_STEP.format(p='r0')}), r2 AS ({_STEP.format(p='r1')}), r3 AS ({_STEP.format(p='r2')})"


def _nodes(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _influence(spark, d):
    return _nodes(spark, d).where("node < 10")


@query(PERSONAL + " SELECT node, round(score, 9) AS score FROM r3")
def graph_personalised_pagerank(spark, d):
    return graph.pagerank(edges(spark, d), start=_influence(spark, d), fixed=3).select("node", F.round("score", 9).alias("score"))


@query(PERSONAL + ", t AS (SELECT node, row_number() OVER (ORDER BY score DESC, node DESC) - 1 AS rank FROM r3) SELECT node, rank FROM t WHERE rank < 50")
def graph_ranking_set(spark, d):
    return graph.ranking_set(edges(spark, d), _influence(spark, d), 50, fixed=3).select("node", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {EDGES}, {NODES} SELECT node, 'blogs' AS name FROM nd WHERE node IN (3, 5, 8, 2000) UNION ALL SELECT node, 'wiki' FROM nd WHERE node IN (8, 9)")
def graph_special_sets(spark, d):
    lists = spark.createDataFrame([(n, "blogs") for n in (3, 5, 8, 2000)] + [(n, "wiki") for n in (8, 9)], "node long, name string")
    return _nodes(spark, d).join(lists, "node").select("node", "name")


@query(f"WITH {EDGES} SELECT src, count(*) * 1.0::DOUBLE AS total, count(*) AS n_out FROM e GROUP BY src")
def graph_weight_sums(spark, d):
    return graph.weight_sums(edges(spark, d))


@query(f"WITH {EDGES}, p AS (SELECT DISTINCT c_custkey % 1000 AS src, c_nationkey::BIGINT AS dst FROM customer) SELECT p.src, p.dst, e.src IS NOT NULL AS linked, CASE WHEN e.src IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS w FROM p LEFT JOIN e ON e.src = p.src AND e.dst = p.dst")
def graph_has_edges(spark, d):
    pairs = table(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("src"), F.col("c_nationkey").cast("long").alias("dst")).distinct()
    return graph.has_edges(pairs, edges(spark, d))


@query(f"WITH {EDGES} SELECT dst AS src, src AS dst FROM e")
def graph_inverted(spark, d):
    return graph.inverted(edges(spark, d)).select("src", "dst")


@query(f"WITH s AS ({SQL['graph_similarity']}), u AS (SELECT a AS src, b AS dst, value AS w FROM s UNION ALL SELECT b, a, value FROM s) SELECT src, round(sum(w), 6) AS total, count(*) AS n_out FROM u GROUP BY src")
def graph_similarity_source(spark, d):
    pairs = graph.similarity(edges(spark, d)).select("a", "b", F.round("value", 6).alias("value"))
    return graph.weight_sums(graph.undirected(pairs)).select("src", F.round("total", 6).alias("total"), "n_out")


@query(f"WITH c AS ({SQL['graph_connectivity']}) SELECT node, CAST(list_position(['core', 'bidi_hot', 'reachable_hot', 'linking_hot', 'bidi', 'reachable', 'linking', 'unreachable'], class) - 1 AS BIGINT) AS rank FROM c")
def graph_primary_rank(spark, d):
    e = edges(spark, d)
    return graph.primary_rank(e, graph.connectivity(e, _nodes(spark, d).where("node < 20")))


@query(PERSONAL + ", t AS (SELECT node, row_number() OVER (ORDER BY score DESC, node DESC) - 1 AS rank FROM r3) SELECT nd.node, CASE WHEN t.rank < 50 THEN t.rank / 50.0::DOUBLE ELSE 1.0 END::DOUBLE AS rank FROM nd JOIN t USING (node)")
def graph_stored_ranks(spark, d):
    best = graph.ranking_set(edges(spark, d), _influence(spark, d), 50, fixed=3)
    return graph.stored_ranks(_nodes(spark, d), best, 50).select("node", "rank")


@query(f"WITH {EDGES}, i AS (SELECT dst AS node, count(*) AS score FROM e GROUP BY dst) SELECT node, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, node DESC) - 1 AS rank FROM i ORDER BY score DESC, node DESC LIMIT 100")
def graph_top_ranked(spark, d):
    s = edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("score"))
    return graph.top_ranked(s, 100).select("node", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 255 ELSE greatest(1, least(255, floor(o_orderkey * 255 / 50000.0::DOUBLE))) END AS BIGINT) AS scaled FROM orders")
def graph_scaled_ranks(spark, d):
    rank = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", graph.scale_rank(rank).alias("scaled"))


@query(f"WITH {EDGES}, parts AS (SELECT src, dst, src % 4 AS part FROM e) SELECT dst, count(*) AS n_in FROM parts WHERE dst < 100 GROUP BY dst")
def graph_links_of_all_parts(spark, d):
    parts = [edges(spark, d).where(F.col("src") % 4 == i) for i in range(4)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("dst < 100").groupBy("dst").agg(F.count("*").alias("n_in"))
