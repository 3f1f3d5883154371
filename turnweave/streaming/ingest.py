"""Incremental ingestion of turns with Structured Streaming.

New turns arrive as files; per-conversation counts are kept as state and written whole for
every changed conversation, so the newest row of a conversation is its current value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "conv_id string, pos int, text string, speaker string, action string, annotation string, native_label string"


def turn_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, last_pos, speakers): updated as turns arrive, late ones included; speakers are an approximate distinct count."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("pos").alias("last_pos"), F.approx_count_distinct("speaker").alias("speakers"))


def start(counts: DataFrame, target: str, checkpoint: str):
    """Append each batch's changed counts to `target` with its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
