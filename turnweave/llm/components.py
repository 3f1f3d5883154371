"""Connected components by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.storage import Workspace


def components(edges: DataFrame, space: Workspace | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Nodes without edges do not appear. Null ends and self loops are ignored and
    repeated edges are harmless; an empty table gives an empty result. Each round
    takes every node's smallest neighbouring label (a pre-aggregated minimum, so a
    hub costs no more than its edges) and then follows the label's own label; labels
    only fall, and the loop ends when none does. Every round is a table in `space` (or
    a folder of its own), so a lost executor costs one round.
    """
    own = space is None
    space = space or Workspace(edges.sparkSession, "components")
    ends = F.expr("inline(array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a)))")
    both = space.table(edges.where("a is not null and b is not null and a <> b").select(ends).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = space.table(labels, "labels")
    while True:
        sent = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "component")
        least = sent.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("head"))
        jumped = least.join(heads, "component", "left").select("node", F.least("component", F.coalesce("head", "component")).alias("component"))
        following = space.table(jumped, "labels")
        moved = following.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").limit(1).count()
        labels = following
        if not moved:
            return space.result(labels) if own else labels
