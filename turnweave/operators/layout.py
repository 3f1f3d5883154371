"""Geometry of the helix view: lanes, angles, radii, bead sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.labels import trusted
from turnweave.schema import Library


def lanes(turns: DataFrame) -> DataFrame:
    """(conv_id, speaker, lane): lanes from 0 by first appearance."""
    first = turns.groupBy("conv_id", "speaker").agg(F.min("pos").alias("first"))
    return first.select("conv_id", "speaker", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")) - 1).alias("lane"))


def helix(lib: Library, shown: int = 24, angle: float = 0.0, radius: float = 132.0, adaptive: bool = True) -> DataFrame:
    """(conv_id, pos, theta, radius, bead) of the first `shown` turns.

    The angle grows faster where speakers switch often (a frame of two turns before and
    after); the radius grows with the farthest trusted answer of the turn.
    """
    by = Window.partitionBy("conv_id").orderBy("pos")
    turns = lib.turns.where(F.col("pos") < shown)
    turns = turns.withColumn("switch", F.when(F.lag("speaker").over(by) != F.col("speaker"), 1.0).when(F.col("pos") > 0, 0.0))
    pace = F.avg("switch").over(by.rowsBetween(-2, 2))  # turn 0 has no switch and is left out of the average
    step = F.when(F.col("pos") == 0, 0.0).otherwise(0.42 + 0.62 * pace if adaptive else F.lit(0.72))
    turns = turns.withColumn("step", step).withColumn("theta", angle + F.sum("step").over(by))
    reach = lib.edges.where(trusted("provenance")).groupBy("conv_id", F.col("source").alias("pos")).agg(F.max(F.abs(F.col("source") - F.col("target"))).alias("far"))
    joined = turns.join(reach, ["conv_id", "pos"], "left")
    spread = radius * (0.72 + 0.28 * F.least(F.coalesce("far", F.lit(0)) / 6, F.lit(1.0)))
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return joined.select("conv_id", "pos", "theta", spread.alias("radius"), F.least(F.lit(17.0), 7 + 1.15 * F.sqrt(words)).alias("bead"))
