"""Connected components of a graph held in DataFrames.

Minimum-label propagation with pointer jumping: every round takes the
smallest label among a node's neighbours, then replaces a label by its own
label, so a path of length n needs about log n rounds.  Edges and labels are
written to the shared folder between rounds: nothing is collected, and the
joins read written tables on both sides, so AQE can split the partition of a
hub node or of the label of a very large component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of an edge; label is the smallest
    node reachable.  Null ends and self loops are ignored; repeated edges
    change nothing; no edges give no rows."""
    pairs = (edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
             .where("a is not null and b is not null and a <> b"))
    both = stored(pairs.union(pairs.select(F.col("b"), F.col("a")))
                  .toDF("src", "dst").distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node"))
                    .agg(F.least(F.min("dst"), F.col("node")).alias("label")), "labels")
    while True:
        # each node's smallest label among itself and its neighbours
        near = (both.join(labels, both.src == labels.node)
                .select(F.col("dst").alias("node"), "label").union(labels)
                .groupBy("node").agg(F.min("label").alias("label")))
        near = stored(near, "labels")
        up = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = stored(near.join(up, "label")
                        .select("node", F.col("up").alias("label")), "labels")
        moved = (jumped.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s
                 != labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s)
        labels = jumped
        if not moved:
            return labels
