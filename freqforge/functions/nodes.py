"""Node attributes beside a graph's edges: samples, effective size, time. Both are tables keyed by graph_id."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "graph_id long, name string, samples int, twoN_param string, twoN double, time_param string, time double, admix_event_time double"
ATTRIBUTES = ["samples", "twoN_param", "twoN", "time_param", "time", "admix_event_time"]


def graph_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """A row for each node of the edges, with its attributes where there are some."""
    names = edges.select("graph_id", F.explode(F.array("from", "to")).alias("name")).distinct()
    if nodes is None:
        nodes = edges.sparkSession.createDataFrame([], NODES)
    return names.join(nodes, ["graph_id", "name"], "left").select("graph_id", "name", *ATTRIBUTES)


def set_node_attrs(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with the attributes of changes (any of the columns) in place of their own; a null leaves what was there, new nodes
    are added."""
    given = [c for c in ATTRIBUTES if c in changes.columns]
    new = changes.select("graph_id", "name", *[F.col(c).alias(f"new_{c}") for c in given])
    joined = nodes.join(new, ["graph_id", "name"], "full")
    return joined.select("graph_id", "name", *[(F.coalesce(f"new_{c}", c) if c in given else F.col(c)).alias(c) for c in ATTRIBUTES])


def prune_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Only nodes that an edge has."""
    return nodes.join(graph_nodes(edges).select("graph_id", "name"), ["graph_id", "name"], "left_semi")


def internal_sampled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with samples that aren't leaves."""
    inner = edges.select("graph_id", F.col("from").alias("name")).distinct()
    return nodes.where("samples > 0").join(inner, ["graph_id", "name"], "left_semi")


def add_sampled_tips(edges: DataFrame, nodes: DataFrame, suffix: str = "_anc") -> tuple[DataFrame, DataFrame]:
    """Sampled inner nodes get a leaf of their own that takes their name, their samples and their time; the node itself has the
    suffix from then on."""
    inner = internal_sampled(nodes, edges).select("graph_id", F.col("name").alias("old"))
    renamed = edges
    for end in ("from", "to"):
        renamed = renamed.join(inner.withColumnRenamed("old", end).withColumn("hit", F.lit(True)), ["graph_id", end], "left").withColumn(end, F.when(F.col("hit"), F.concat(end, F.lit(suffix))).otherwise(F.col(end))).drop("hit")
    tips = inner.select("graph_id", F.concat("old", F.lit(suffix)).alias("from"), F.col("old").alias("to"), F.lit("normal").alias("type"), F.lit(0.0).alias("weight"))
    old = nodes.join(inner.withColumnRenamed("old", "name"), ["graph_id", "name"], "left_semi")
    above = old.withColumns({"name": F.concat("name", F.lit(suffix)), "samples": F.lit(None).cast("int")})
    out = renamed.select("graph_id", "from", "to", "type", "weight").unionByName(tips)
    return out, nodes.unionByName(above)


def refresh_edge_times(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with time_from and time_to as the nodes have them now."""
    for end in ("from", "to"):
        edges = edges.drop(f"time_{end}").join(nodes.select("graph_id", F.col("name").alias(end), F.col("time").alias(f"time_{end}")), ["graph_id", end], "left")
    return edges


def inconsistent_times(edges: DataFrame, nodes: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Edges whose end lies above their start, or whose own times differ from the nodes' by more than tol."""
    now = refresh_edge_times(edges, nodes).select("graph_id", "from", "to", F.col("time_from").alias("a"), F.col("time_to").alias("b"))
    wrong = F.col("b") > F.col("a") + tol
    if "time_from" in edges.columns:
        now = now.join(edges.select("graph_id", "from", "to", "time_from", "time_to"), ["graph_id", "from", "to"])
        wrong = wrong | (F.abs(F.col("a") - F.col("time_from")) > tol) | (F.abs(F.col("b") - F.col("time_to")) > tol)
    return now.where(wrong)
