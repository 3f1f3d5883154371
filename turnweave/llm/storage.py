"""Shared storage for intermediate tables and archives.

``spark.checkpoint.dir`` names a folder that the driver and every executor see.
It is read from the session. Where it is unset, a local master gets a folder of its
own (tests, a laptop) and any other master an error, since executors of a cluster
would write to their own disks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/turnweave-shared"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; the local default is set only when there is none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme of its file system, so that Spark and other readers mean the same place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the planner exact sizes.
    """
    return _written(df, new_folder(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` and read back; once it is written, nothing needs its shuffle files, and Spark is told to remove them."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder for the tables of one call; they go when the call's result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.made = spark, name, new_folder(spark, name), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written under the folder and read back."""
        self.made += 1
        path = f"{self.path}/{self.made:03d}-{name}"
        return _written(df, path)

    def result(self, df: DataFrame) -> DataFrame:
        """`df` as a table of its own, which stays for whoever reads it; all others are deleted."""
        out = materialise(df, self.name)
        delete_tree(self.spark, self.path)
        return out


def delete_tree(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
