"""Queries of graph operators over many graphs that the tables hold.

The world's graph has a root, the regions, and the nations as leaves; every sixth nation also descends from the next region,
so it is admixed. Graph k is the world's without region k.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import graph as G
from ..operators import graphfit as T
from .queries import query

_CTES = """e0(r, f, t) AS (SELECT r_regionkey, 'world', r_name FROM region UNION ALL SELECT n_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT (n_regionkey + 1) % 5, r_name, n_name FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % 5 WHERE n_nationkey % 6 = 0),
ed(i, f, t) AS (SELECT CAST(k AS BIGINT), f, t FROM (SELECT unnest(range(5)) AS k) JOIN e0 ON r <> k),
lf(i, x, n) AS (SELECT i, t, count(*) FROM ed WHERE f <> 'world' GROUP BY i, t)"""


def worlds(spark, d):
    """graph_id, edges."""
    region, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    second = nation.where("n_nationkey % 6 = 0").join(region, (F.col("n_regionkey") + 1) % 5 == F.col("r_regionkey"))
    edges = region.select("r_regionkey", F.lit("world").alias("from"), F.col("r_name").alias("to"))
    for part in (first, second):
        edges = edges.unionByName(part.select("r_regionkey", F.col("r_name").alias("from"), F.col("n_name").alias("to")))
    each = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("graph_id")).where("r_regionkey <> graph_id")
    return each.groupBy(F.col("graph_id").cast("long").alias("graph_id")).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("edges"))  # an edge a nation


@query("SELECT i AS graph_id, x AS pop, CAST(n > 1 AS INT) AS n FROM lf", _CTES)
def graph_count_admix(spark, d):
    return T.summaries(worlds(spark, d), "count_admix")


@query("""SELECT ed.i AS graph_id, f AS "from", t AS "to", CASE WHEN f = 'world' THEN (SELECT string_agg(b.t, ',' ORDER BY b.t) FROM ed b WHERE b.i = ed.i AND b.f = ed.t) ELSE t END AS targets, TRUE AS identifiable FROM ed""", _CTES)
def graph_edge_targets(spark, d):
    return T.summaries(worlds(spark, d), "edge_targets").withColumn("targets", F.array_join("targets", ","))


@query("""SELECT DISTINCT a.i AS graph_id, o.x AS outgroup, a.t AS pop1, b.t AS pop2 FROM ed a JOIN ed b ON a.i = b.i AND a.f = b.f AND a.t < b.t AND a.f <> 'world' JOIN lf o ON o.i = a.i
WHERE NOT EXISTS (SELECT 1 FROM ed z WHERE z.i = a.i AND z.f = a.f AND z.t = o.x)""", _CTES)
def graph_triplets(spark, d):
    return T.summaries(worlds(spark, d), "triplets")


@query("""SELECT i AS graph_id, t AS pop, 'world>' || f || '>' || t AS path, CASE WHEN n > 1 THEN f || '|' || t ELSE '' END AS admedges FROM ed JOIN lf USING (i) WHERE lf.x = ed.t""", _CTES)
def graph_root_paths(spark, d):
    return T.summaries(worlds(spark, d), "root_paths").withColumn("path", F.array_join("path", ">")).withColumn("admedges", F.array_join("admedges", ","))


@query("""SELECT i AS graph_id, f AS node, string_agg(t, chr(10) ORDER BY t) AS name FROM ed WHERE f <> 'world' GROUP BY i, f
UNION ALL SELECT i, 'world', string_agg(x, chr(10) ORDER BY x) FROM lf GROUP BY i UNION ALL SELECT i, x, x FROM lf""", _CTES)
def graph_node_names(spark, d):
    return T.summaries(worlds(spark, d), "node_names")


@query("""SELECT a.i AS graph_id, a.x AS pop1, b.x AS pop2, CAST(a.n = 1 AND b.n > 1 AS INT) - CAST(b.n = 1 AND a.n > 1 AS INT) AS dir FROM lf a JOIN lf b ON a.i = b.i AND a.x < b.x""", _CTES)
def graph_pair_admix(spark, d):
    return T.summaries(worlds(spark, d), "pair_admix")


@query("""SELECT i AS graph_id, string_agg(x, ' ' ORDER BY x) FILTER (n = 1) AS "from", CAST(count(*) FILTER (n > 1) AS BIGINT) AS below FROM lf GROUP BY i""", _CTES)
def graph_condensed(spark, d):
    return T.summaries(worlds(spark, d), "condensed").groupBy("graph_id", "from").agg(F.count("to").alias("below"))


@query("""SELECT pop1, pop2, CAST(count(*) AS BIGINT) AS n_graphs, round(count(*) / 5e0, 9) AS share FROM (
SELECT a.i, a.x AS pop1, b.x AS pop2 FROM lf a JOIN lf b ON a.i = b.i AND a.x < b.x WHERE a.n = 1 AND b.n > 1) GROUP BY 1, 2""", _CTES)
def graph_pair_support(spark, d):
    """In how many of the graphs admixture goes from one leaf's group to another's."""
    return T.summary_support(T.summaries(worlds(spark, d), "pair_admix").where("dir = 1").drop("dir"))


@query("""SELECT x.i AS graph_id, x.x AS pop1, y.x AS pop2, round(coalesce(s.n, 0) * 1e0 + 1, 9) / (x.n + y.n + 1 - coalesce(s.n, 0)) AS share FROM lf x JOIN lf y ON x.i = y.i AND x.x < y.x
LEFT JOIN (SELECT a.i, a.t AS p, b.t AS q, count(*) AS n FROM ed a JOIN ed b ON a.i = b.i AND a.f = b.f AND a.f <> 'world' GROUP BY 1, 2, 3) s ON s.i = x.i AND s.p = x.x AND s.q = y.x""".replace("round(coalesce(s.n, 0) * 1e0 + 1, 9) / (x.n + y.n + 1 - coalesce(s.n, 0)) AS", "round((coalesce(s.n, 0) + 1e0) / (x.n + y.n + 1 - coalesce(s.n, 0)), 9) AS"), _CTES)
def graph_shared_ancestors(spark, d):
    return T.summaries(worlds(spark, d), "pair_percentages")


@query("SELECT CAST(product(2 * k - 3) AS BIGINT) AS trees FROM (SELECT unnest(range(2, 1 + (SELECT count(*) FROM region))) AS k)", "")
def graph_all_trees(spark, d):
    """Rooted trees of the regions, the last leaf added in tasks."""
    names = sorted(r["r_name"] for r in spark.read.parquet(f"{d}/region.parquet").select("r_name").collect())  # five
    trees = T.graphs_table(spark, list(G.all_trees(names[:-1]))).repartition(4)
    return T.enumerate_graphs(trees, lambda t: G.grown(t, names[-1])).agg(F.count_distinct("hash").alias("trees"))
