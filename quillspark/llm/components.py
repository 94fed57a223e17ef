"""Connected components of an edge table, without moving edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label), stored: the smallest node of each node's component, for nodes that have an edge.

    Each round takes the smallest label among a node and its neighbours, then follows that label once (pointer
    jumping), so the rounds needed grow with the logarithm of a component's diameter. Minima combine map-side, so a
    node with a third of all edges is one row per task; labels are written to the shared folder between rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = stored(step, "step")
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = stored(step.join(jump, step["label"] == jump["via"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = after.filter("old <> label").limit(1).count()
        forget(labels, step)
        labels = after
        if not changed:
            forget(both)
            return after
