"""Connected components by repeated hooking and contraction, all in DataFrames.

Every round hooks each node to its smallest smaller neighbour (one partially aggregated
group-by), flattens the resulting trees by pointer jumping and rewrites the remaining
edges between roots.  At least half of the nodes that still have edges vanish in a
round.  Nothing is collected but row counts; each step is a written table, so a join
on a hub node has fresh exchanges on both sides and adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, the smallest node reachable.

    Nodes without an edge to another node are absent.  Nulls, loops and repeated edges
    are ignored.
    """
    edges = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    labels = ws.save(edges.select(F.col("lo").alias("node")).union(edges.select("hi")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        parent = ws.save(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = ws.save(parent.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            ws.drop(parent)
            parent, jumped = jumped.select("node", "root"), None
            parent._workspace_path = f"{ws.root}/t{ws.count}"
            if not moved:
                break
        low = parent.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        high = parent.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        mapped = edges.join(low, "lo", "left").join(high, "hi", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
        rest = ws.save(mapped.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
        root = parent.select(F.col("node").alias("component"), "root")
        next_labels = ws.save(labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        ws.drop(edges, labels, parent)
        edges, labels = rest, next_labels
    ws.drop(edges)
    return labels
