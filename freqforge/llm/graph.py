"""Connected components of a table of links, in DataFrame joins only."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

MAX_ROUNDS = 60


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of the component of each of 0 to n - 1, which a[i]-b[i] link."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    return low


def _least(edges: DataFrame) -> DataFrame:
    """node, m, c: the least neighbour of the nodes that have a smaller one, and how many they have; a table of its own, so
    that a hub on the other side of a join is split by adaptive execution."""
    return table(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"), F.count("*").alias("c")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: the least node that can be reached. Nodes without links are not in it.

    Alternating stars over pairs (hi, lo). Large star: each larger neighbour of a node goes to the least one around that
    node. Small star: the smaller neighbours and the node itself do. Each step is written to the shared folder and what came
    before is removed; rounds grow with the logarithm of the diameter."""
    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        least = _least(now)
        above = F.col("lo") == F.col("node")
        if least.where("c > 1").select("node").unionAll(now.join(least, above, "left_semi").select("hi")).isEmpty():
            drop(least)
            break
        large = table(now.join(least, above, "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "links")
        drop(now, least)
        least = _least(large)
        small = large.join(least, F.col("hi") == F.col("node")).select(F.inline(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
        now = table(small.where("hi <> lo").distinct(), "links")
        drop(large, least)
    else:
        raise RuntimeError(f"components: no fixpoint after {MAX_ROUNDS} rounds")
    tops = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(tops)


def component_ids(root: DataFrame, least: DataFrame) -> DataFrame:
    """root (node, root) and least (node, least), a row a node, linked or not -> node, component_id: the least of the node's
    component."""
    linked = root.join(least, "node")
    of = table(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    found = root.join(of, "root").select("node", "component_id")
    return least.join(found, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
