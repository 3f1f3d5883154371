"""Retrieval metrics, bootstrap intervals and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, by: str = "query", score: str = "score", tie: str = "doc", k: int = 10) -> DataFrame:
    """The `k` best rows of every query by score descending, then tie; `rank` from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ir_metrics(rows: DataFrame) -> DataFrame:
    """(query, p5, p10, success10, rr10) from (query, rank, relevant)."""
    rel = F.col("relevant").cast("int")
    first = F.min(F.when(rel == 1, F.col("rank")))
    return rows.where("rank <= 10").groupBy("query").agg(
        (F.sum(F.when(F.col("rank") <= 5, rel).otherwise(0)) / 5).alias("p5"),
        (F.sum(rel) / 10).alias("p10"),
        F.max(rel).alias("success10"),
        F.coalesce(1 / first, F.lit(0.0)).alias("rr10"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in ("p5", "p10", "success10", "rr10")])


def bootstrap(values: DataFrame, column: str, draws: int = 2000, seed: int = 577) -> DataFrame:
    """(mean, low, high): a percentile interval of the mean over `draws` resamples.

    A resample of n values with replacement gives every value a count that is nearly
    Poisson(1); counts are drawn per (value, draw) from a hash, so rows are neither
    numbered nor gathered, and the work is one pass of n x draws sums.
    """
    unit = (F.pmod(F.xxhash64(F.lit(seed), "id", "draw"), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):  # the Poisson(1) distribution function
        total += term
        cuts.append(total)
        term /= k + 1
    count: Column = F.lit(12)
    for k in range(11, -1, -1):
        count = F.when(F.col("u") < cuts[k], F.lit(k)).otherwise(count)
    rows = values.select("id", F.col(column).alias("v")).crossJoin(F.broadcast(values.sparkSession.range(draws).withColumnRenamed("id", "draw")))
    drawn = rows.withColumn("u", unit).withColumn("c", count).groupBy("draw").agg((F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m"))
    ends = drawn.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return values.agg(F.avg(column).alias("mean")).crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def quantiles(rows: DataFrame, column: str) -> DataFrame:
    """(p50, p95), interpolated."""
    return rows.agg(F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"))
