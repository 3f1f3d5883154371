"""A bounded, reproducible sample of labelled documents for fitting a model on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SAMPLE = 4000
MAX_SAMPLE_CHARS = 8_000_000


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def sample(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, max_rows: int = MAX_SAMPLE, max_chars: int = MAX_SAMPLE_CHARS) -> pd.DataFrame:
    """At most `max_rows` (text, label) of labelled documents, in the order of a hash of the id.

    `allowed` is a condition on labels.doc_id. Rows are taken while their whole texts fit
    `max_chars` together, so the driver holds a bounded amount whatever the lengths; a text
    of more than a twentieth of `max_chars` is not learnt from, so that no few texts fill
    the sample. Rows are chosen by id, text hash and length, and only then are texts
    fetched. Rows with a null id, label or text and ids with contradictory labels are left
    out; documents that repeat with one id and text count once.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & allowed)
    clean = clean.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2")).where("y = y2")
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = clean.select(F.col("doc_id").alias("__tw_label_id"), F.col("y").cast("int"), order.alias("__tw_order")).orderBy("__tw_order").limit(max_rows)
    slim = docs.select("doc_id", "text").where("text is not null").withColumn("__tw_hash", F.xxhash64("text"))
    joined = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("__tw_label_id"))  # at most max_rows rows of three short columns
    sized = joined.groupBy("__tw_order", "__tw_hash").agg(F.first(F.length("text")).alias("n"), F.first("y").alias("y"))
    first = sized.where(F.col("n") <= max_chars // 20).orderBy("__tw_order", "__tw_hash").limit(max_rows)
    held = F.sum("n").over(Window.orderBy("__tw_order", "__tw_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most max_rows short rows
    taken = first.withColumn("__tw_held", held).where(F.col("__tw_held") <= max_chars).select("__tw_order", "__tw_hash", "y").collect()
    label = {(r["__tw_order"], r["__tw_hash"]): r["y"] for r in taken}
    if not label:
        return pd.DataFrame({"text": pd.Series(dtype=object), "y": pd.Series(dtype=int)})
    keys = docs.sparkSession.createDataFrame(list(label), "__tw_o string, __tw_h long")
    of_id = F.md5(F.col("doc_id").cast("string"))
    found = slim.join(F.broadcast(keys), (of_id == F.col("__tw_o")) & (F.col("__tw_hash") == F.col("__tw_h")), "inner")
    rows = found.groupBy("__tw_o", "__tw_h").agg(F.first("text").alias("text")).collect()  # at most max_rows texts, max_chars together
    rows.sort(key=lambda r: (r["__tw_o"], r["__tw_h"]))
    return pd.DataFrame([(r["text"], label[r["__tw_o"], r["__tw_h"]]) for r in rows], columns=["text", "y"])
