"""Writing: staged tables, the Parquet index and atlas, and JSON exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.schema import Library

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local default only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "file:///tmp/turnweave-shared").rstrip("/") + "/dialogue"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`df` written to shared storage, in `folder` if one is given, and read back; Spark is told to remove the shuffle files of the write."""
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else new_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    _, target, fs = _hadoop(spark, path)
    fs.delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _install(spark: SparkSession, path: str, version: str) -> None:
    """Let `path`'s pointer name `version`: one rename over the old pointer, so readers see the old version or the new one, whole."""
    draft = f"{path}/CURRENT.{version}"
    jvm, new, fs = _hadoop(spark, draft)
    out = fs.create(new)
    out.write(bytearray(version.encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), overwrite)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the installed version."""
    jvm, pointer, fs = _hadoop(spark, f"{path}/CURRENT")
    if not fs.exists(pointer):
        raise LookupError(f"nothing is installed at {path}")
    stream = fs.open(pointer)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    return f"{path}/versions/{version}"


def prune(spark: SparkSession, path: str) -> None:
    """Delete all versions but the installed one; call it when no reader holds an older one."""
    keep = current(spark, path).rsplit("/", 1)[1]
    _, versions, fs = _hadoop(spark, f"{path}/versions")
    for found in fs.listStatus(versions):
        if found.getPath().getName() != keep:
            fs.delete(found.getPath(), True)


def write_index(lib: Library, episodes: DataFrame, stats: DataFrame, path: str) -> None:
    """Write conversations, turns, edges, episodes and stats, partitioned by corpus, as a version of their own, and then install it."""
    spark = lib.turns.sparkSession
    version = uuid.uuid4().hex
    building = f"{path}/versions/{version}"
    corpora = lib.conversations.select("conv_id", "corpus")
    lib.conversations.write.partitionBy("corpus").parquet(f"{building}/conversations")
    for name, table in (("turns", lib.turns), ("edges", lib.edges)):
        table.join(corpora, "conv_id").repartition("corpus", "conv_id").sortWithinPartitions("conv_id").write.partitionBy("corpus").parquet(f"{building}/{name}")
    episodes.write.partitionBy("corpus").parquet(f"{building}/episodes")
    stats.write.parquet(f"{building}/stats")
    _install(spark, path, version)


def read_index(spark: SparkSession, path: str) -> tuple[Library, DataFrame, DataFrame]:
    there = current(spark, path)
    table = lambda name: spark.read.parquet(f"{there}/{name}")
    return Library(table("conversations"), table("turns").drop("corpus"), table("edges").drop("corpus")), table("episodes"), table("stats")


def write_atlas(atlas: DataFrame, path: str) -> None:
    version = uuid.uuid4().hex
    atlas.write.partitionBy("corpus").parquet(f"{path}/versions/{version}")
    _install(atlas.sparkSession, path, version)


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON document a corpus, as text lines, as a version of its own."""
    version = uuid.uuid4().hex
    stats_json(stats).write.json(f"{path}/versions/{version}")
    _install(stats.sparkSession, path, version)


def stats_json(stats: DataFrame) -> DataFrame:
    """(corpus, json): one JSON object per corpus, nulls kept."""
    return stats.select("corpus", F.to_json(F.struct(*sorted(c for c in stats.columns if c != "corpus")), {"ignoreNullFields": "false"}).alias("json"))


def evidence_json(episode: DataFrame, overrides: DataFrame | None = None, comparison: DataFrame | None = None) -> DataFrame:
    """(json) export of one episode: schema, bounds, overrides, untouched turns and edges, and the episode it is compared with.

    `comparison` is one row of a match (conv_id, start, stop, score and what else it holds).
    """
    changed = F.array().cast("array<struct<turn:int,action:string>>")
    if overrides is not None:
        rows = overrides.agg(F.array_sort(F.collect_list(F.struct("turn", "action"))).alias("overrides"))  # at most 50 rows
        episode, changed = episode.crossJoin(F.broadcast(rows)), F.col("overrides")
    compared = F.lit(None).cast("string")
    if comparison is not None:
        row = comparison.limit(1).select(F.struct(*comparison.columns).alias("__compared"))
        episode, compared = episode.join(F.broadcast(row), F.lit(True), "left"), F.col("__compared")  # one row
    body = F.struct(F.lit("turnweave-evidence/1").alias("schema"), "conv_id", "corpus", "start", "stop", changed.alias("overrides"), "turns", "edges", "external_edges", compared.alias("comparison"))
    return episode.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def cohort_json(cohort: DataFrame, metrics: DataFrame, filters: dict[str, str], pinned: DataFrame | None = None) -> DataFrame:
    """(episode_id, json) lines of a cohort export: metrics and filters on every line, so that no list of ids is gathered.

    `metrics` is one row, and `pinned` the one row of metrics of the cohort held for comparison.
    """
    metrics = metrics.limit(1).select(F.struct(*metrics.columns).alias("__metrics"))
    compared = F.lit(None).cast("string")
    if pinned is not None:
        metrics, compared = metrics.crossJoin(pinned.limit(1).select(F.struct(*pinned.columns).alias("__pinned"))), F.col("__pinned")
    named = F.create_map(*[F.lit(x) for kv in sorted(filters.items()) for x in kv]) if filters else F.create_map().cast("map<string,string>")
    line = F.struct(F.lit("turnweave-cohort/1").alias("schema"), "episode_id", named.alias("filters"), F.col("__metrics").alias("metrics"), compared.alias("pinned"))
    return cohort.select("episode_id").crossJoin(F.broadcast(metrics)).select("episode_id", F.to_json(line, {"ignoreNullFields": "false"}).alias("json"))
