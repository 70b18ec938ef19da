"""Edge tables of many graphs (graph_id, from, to, type, weight): degrees, classes of edges, closures and supports."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, indegree, outdegree."""
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("from").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("graph_id", "node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def with_class(edges: DataFrame) -> DataFrame:
    """type from the graph itself: admix where a node has two parents."""
    k = F.count("*").over(Window.partitionBy("graph_id", "to"))
    return edges.withColumn("type", F.when(k == 2, "admix").otherwise("normal"))


def num_admix(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.groupBy("graph_id").agg(F.count(F.when(F.col("indegree") > 1, 1)).alias("numadmix"), F.count(F.when(F.col("outdegree") == 0, 1)).alias("leaves"), F.max(F.when(F.col("indegree") == 0, F.col("node"))).alias("root"))


def closure(edges: DataFrame) -> DataFrame:
    """graph_id, node, below: every node and what can be reached from it."""
    return edges.sparkSession.sql("""
        WITH RECURSIVE down(graph_id, node, below) AS (
          SELECT graph_id, `from`, `to` FROM {e}
          UNION ALL SELECT d.graph_id, d.node, e.`to` FROM down d JOIN {e} e ON e.graph_id = d.graph_id AND e.`from` = d.below)
        SELECT DISTINCT graph_id, node, below FROM down""", e=edges)


def count_zero_edges(edges: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    return edges.where("type <> 'admix'").groupBy("graph_id").agg(F.count(F.when(F.col("weight") < epsilon, 1)).alias("zero_edges"))


def drift_partition(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Drift summed by the set of leaves below an edge: graph_id, below (sorted), drift. leaves: graph_id, node, leaf (as in
    the summary `descendants`)."""
    tips = leaves.select("graph_id", F.col("leaf").alias("node"), "leaf").distinct()
    under = leaves.unionByName(tips).groupBy("graph_id", "node").agg(F.array_join(F.sort_array(F.collect_set("leaf")), ",").alias("below"))
    e = edges.where("type <> 'admix'").join(under.withColumnRenamed("node", "to"), ["graph_id", "to"])
    return e.groupBy("graph_id", "below").agg(F.sum("weight").alias("drift"))


def confints(fits: DataFrame, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean, standard error and quantiles of a value over fits."""
    return fits.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"), F.expr(f"percentile({value}, {low})").alias("low"), F.expr(f"percentile({value}, {high})").alias("high"))


def shortest_unique_prefixes(names: DataFrame, column: str, least: int = 1) -> DataFrame:
    """name, prefix: the shortest start that no other name has; a name that starts another one is its own."""
    n = names.select(F.col(column).alias("name")).distinct()
    parts = n.select("name", F.explode(F.sequence(F.lit(least), F.greatest(F.length("name"), F.lit(least)))).alias("k")).withColumn("prefix", F.expr("substring(name, 1, k)"))
    alone = parts.withColumn("c", F.count("*").over(Window.partitionBy("prefix")))
    first = alone.groupBy("name").agg(F.min(F.when(F.col("c") == 1, F.col("k"))).alias("k"))
    return first.select("name", F.when(F.col("k").isNull(), F.col("name")).otherwise(F.expr("substring(name, 1, k)")).alias("prefix"))


def weighted_means(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over rows that have a value."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias("mean"))


def f2_blocks_from_means(f2dat: DataFrame, nblocks: int = 1000, cv: float = 0.1, seed: int = 0) -> DataFrame:
    """Long f2 -> block table with the means and noise of this coefficient of variation."""
    rows = f2dat.select("pop1", "pop2", "est", F.explode(F.sequence(F.lit(1), F.lit(nblocks))).alias("block"))
    return rows.withColumn("est", F.col("est") * (1 + cv * F.randn(seed))).withColumn("n_snps", F.lit(1))
