"""Cohorts on the map: lenses, regions, metrics, composition, comparison, pathways, nearest points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.labels import JITTER_X, JITTER_Y, jitter
from turnweave.schema import FLAGS


def lens(rows: DataFrame, flags: int) -> DataFrame:
    """Episodes that show every flag of the mask."""
    return rows.where(F.col("flags").bitwiseAND(flags) == flags)


def jittered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"jx": F.expr(f"x + {jitter(JITTER_X)}"), "jy": F.expr(f"y + {jitter(JITTER_Y)}")})


def region(rows: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Episodes inside an inclusive rectangle of jittered coordinates; bounds come in any order."""
    (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
    return jittered(rows).where(F.col("jx").between(x0, x1) & F.col("jy").between(y0, y1))


def metrics(cohort: DataFrame) -> DataFrame:
    """One row: size, mean speakers, shares; null where there is nothing to divide by."""
    share = lambda c: F.try_divide(F.sum(c.cast("int")), F.count("*"))
    return cohort.agg(
        F.count("*").alias("n"),
        F.avg("speakers").alias("mean_speakers"),
        share(F.col("speakers") >= 3).alias("group_share"),
        F.avg("reach").alias("mean_reach"),
        F.try_divide(F.sum("nonadjacent"), F.sum("edge_count")).alias("nonadjacent_share"),
        F.avg("known").alias("mean_known"),
        share(F.col("flags").bitwiseAND(FLAGS["targets_available"]) > 0).alias("target_share"),
    )


def composition(cohort: DataFrame) -> DataFrame:
    """(corpus, n, percent), largest first."""
    counts = cohort.groupBy("corpus").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("corpus", "n", F.round(F.col("n") * 100 / F.col("total"), 0).cast("int").alias("percent"))


def compare(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Differences in percentage points of the current cohort against the pinned one."""
    a = metrics(pinned).select(F.col("group_share").alias("g0"), F.col("mean_known").alias("k0"))
    b = metrics(current).select(F.col("group_share").alias("g1"), F.col("mean_known").alias("k1"))
    return a.crossJoin(b).select(((F.col("g1") - F.col("g0")) * 100).alias("group_points"), ((F.col("k1") - F.col("k0")) * 100).alias("coverage_points"))


def pathways(census: DataFrame, labels: DataFrame) -> DataFrame:
    """Dense (from_move, to_move, n, intensity) matrix over the given labels, zero-filled."""
    grid = labels.select(F.col("move").alias("from_move")).crossJoin(labels.select(F.col("move").alias("to_move")))  # at most 13 x 13
    totals = census.groupBy("from_move", "to_move").agg(F.sum("n").alias("n"))
    full = grid.join(totals, ["from_move", "to_move"], "left").na.fill(0, ["n"])
    most = totals.agg(F.max("n").alias("most"))
    level = F.when(F.col("n") > 0, 0.12 + 0.84 * F.log1p("n") / F.log1p("most")).otherwise(0.0)
    return full.crossJoin(F.broadcast(most)).select("from_move", "to_move", "n", level.alias("intensity"))


def example(cohort: DataFrame) -> DataFrame:
    """One episode to open first: a small group with a clarification, else a group, else any."""
    rank = F.expr("CASE WHEN speakers >= 3 AND (flags & 4) > 0 AND turn_count <= 10 THEN 0 WHEN speakers >= 3 THEN 1 ELSE 2 END")
    return cohort.agg(F.min_by("episode_id", F.struct(rank, "episode_id")).alias("episode_id"))


def nearest(rows: DataFrame, pointers: DataFrame, width: float, height: float, cell: float = 18.0, reach: float = 10.0) -> DataFrame:
    """(pointer, episode_id, distance): the nearest episode nearer than `reach` pixels.

    Both sides go to grid cells; a pointer asks its nine neighbours by an equi-join.
    """
    points = jittered(rows).select("episode_id", (F.col("jx") * width).alias("px"), (F.col("jy") * height).alias("py"))
    points = points.withColumns({"gx": F.floor(F.col("px") / cell), "gy": F.floor(F.col("py") / cell)})
    around = pointers.select("pointer", "qx", "qy", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx"))
    around = around.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    around = around.withColumns({"gx": F.floor(F.col("qx") / cell) + F.col("dx"), "gy": F.floor(F.col("qy") / cell) + F.col("dy")})
    near = around.join(points, ["gx", "gy"]).withColumn("distance", F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")))
    best = near.where(F.col("distance") < reach).groupBy("pointer").agg(F.min(F.struct("distance", "episode_id")).alias("b"))
    return best.select("pointer", F.col("b.episode_id").alias("episode_id"), F.col("b.distance").alias("distance"))
