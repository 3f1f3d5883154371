"""The queries of the ten operators and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import bagminhash, decontam, licenses, mixing, quality, secretscan, sharding, toxicity, vecgraph, warc
from turnweave.llm.labelled import id_remainder
from turnweave.llm.oracles import ORACLES
from turnweave.llm.rowkeys import ID


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = F.filter(spans, lambda s: s["ord"] < len(secretscan.BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secretscan.BASE_KINDS],
        F.sha2(secretscan.listed(base), 256).alias("base_sha256"),
        secretscan.listed(spans).alias("spans"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col(ID).alias("doc_id"), F.col("head.id").alias("class_id"), "kept")


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.assign_copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.col("places")
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"])))
    starts = F.transform(places, lambda p: p["start"])
    return found.select(
        F.col(ID).alias("doc_id"),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "template_labels")), ",").alias("labels"),
        "score",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_model(docs, _table(spark, sf_dir, "labels"))
    modulus, held = toxicity.HOLD_OUT
    found = toxicity.scored_ids(docs, model)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.near_links(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(decontam.covered(F.col("runs")), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        F.col(ID).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train_model(docs, _table(spark, sf_dir, "labels"))
    modulus, held = quality.HOLD_OUT
    found = quality.scored_ids(docs, forest)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_minhash_near_dedup,
        op3_license_scan,
        op4_feistel_sharding,
        op5_source_mixing,
        op6_toxicity,
        op7_embedding_near_dedup,
        op8_warc_round_trip,
        op9_decontamination,
        op10_quality,
    )
}

__all__ = ["ORACLES", "QUERIES"]
