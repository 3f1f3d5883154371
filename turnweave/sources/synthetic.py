"""Dialogue libraries derived from generic tables by fixed rules.

The labels of `threads` and `long` are synthetic and carry the provenance "synthetic-example".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.schema import Library


SPLIT = "map('split', CASE WHEN {} % 5 = 0 THEN 'test' ELSE 'train' END) AS meta"  # every fifth conversation is for testing


def chat(conversations: DataFrame) -> Library:
    """Role-labelled chats: speaker and action are the role, every turn follows the one before."""
    turns = conversations.selectExpr(
        "concat('chat:', conv_id) AS conv_id", "cast(turn AS INT) AS pos", "text", "role AS speaker", "role AS action", "'source-role' AS annotation", "cast(NULL AS STRING) AS native_label"
    )
    edges = turns.where("pos > 0").selectExpr("conv_id", "pos - 1 AS ord", "pos AS source", "pos - 1 AS target", "'temporal' AS type", "'chronological' AS provenance")
    heads = conversations.select("conv_id").distinct()
    convs = heads.selectExpr("concat('chat:', conv_id) AS conv_id", "cast(conv_id AS STRING) AS source_id", "'chat' AS corpus", "0 AS corpus_ord", "conv_id AS ordinal", "cast(NULL AS STRING) AS title", SPLIT.format("conv_id"))
    return Library(convs, turns, edges)


def threads(events: DataFrame, length: int, corpus: str, corpus_ord: int) -> Library:
    """Multi-party threads of `length` consecutive events; each event answers one of the three before."""
    base = events.selectExpr(
        f"event_id DIV {length} AS ordinal",
        f"concat('{corpus}:', event_id DIV {length}) AS conv_id",
        f"cast(event_id % {length} AS INT) AS pos",
        "concat(event_type, ' ', props) AS text",
        "concat('S', user_id % 4) AS speaker",
        "CASE event_type WHEN 'signup' THEN 'question' WHEN 'error' THEN 'clarify' WHEN 'click' THEN 'answer' WHEN 'view' THEN 'comment' ELSE 'acknowledge' END AS action",
        f"cast(greatest(0, event_id % {length} - 1 - ((event_id * 7 + user_id) % 3)) AS INT) AS target",
    )
    turns = base.selectExpr("conv_id", "pos", "text", "speaker", "action", "'synthetic-example' AS annotation", "cast(NULL AS STRING) AS native_label")
    kind = "CASE action WHEN 'clarify' THEN 'Clarification_question' WHEN 'answer' THEN 'QAP' ELSE 'Comment' END AS type"
    edges = base.where("pos > 0").selectExpr("conv_id", "pos - 1 AS ord", "pos AS source", "target", kind, "'synthetic-example' AS provenance")
    convs = base.select("conv_id", "ordinal").distinct()
    convs = convs.selectExpr("conv_id", "cast(ordinal AS STRING) AS source_id", f"'{corpus}' AS corpus", f"{corpus_ord} AS corpus_ord", "ordinal", "cast(NULL AS STRING) AS title", SPLIT.format("ordinal"))
    return Library(convs, turns, edges)


def library(spark: SparkSession, sf_dir: str) -> Library:
    """The chats, the threads of nine events and the long threads of forty."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props")
    chats = chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chats.union(threads(events, 9, "threads", 1)).union(threads(events, 40, "long", 2))
