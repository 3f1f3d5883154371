"""Connected components over edge tables by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators.sinks import staged


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node within reach. Every round is staged in shared storage, in `folder` if one is given."""
    ends = F.expr("inline(array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a)))")
    both = staged(edges.where("a <> b").select(ends).distinct(), folder)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), folder)
    while True:
        sent = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "component")
        least = sent.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("head"))
        after = staged(least.join(heads, "component", "left").select("node", F.least("component", F.coalesce("head", "component")).alias("component")), folder)
        moved = after.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before").limit(1).count()
        labels = after
        if not moved:
            return labels
