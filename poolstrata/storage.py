"""Intermediate tables in the folder that the driver and all executors share, and how their rows are joined."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in spark.checkpoint.dir; where that is unset, in a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("poolstrata.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("poolstrata.shared.dir", where)
    return f"{where}/{name}-{uuid.uuid4().hex}"


#: A number by which rows are dealt, where they carry one; it determines the ids that tell them apart.
OWNER = "owner"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what follows reads it as often as it likes, and a lost executor costs no recomputation
    of what led to it. Rows with an owner are bucketed by it, so that what is folded or joined by it doesn't move
    (after a Python function Spark deals them again, as it knows nothing of where its rows lie)."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    if OWNER in df.columns:
        # the owner determines the other keys of a join, so rows that are dealt by it alone are together already
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file, so a merge by owner sorts nothing
        table, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, OWNER).write.bucketBy(buckets, OWNER).sortBy(OWNER).option("path", path).saveAsTable(table)
        return matched(spark.table(table))
    df.write.parquet(path)
    return matched(spark.read.schema(df.schema).parquet(path))


def placed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df, written once and bucketed by keys: what is joined by them, or by them and more, stays where it lies."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_folder(spark, name)).saveAsTable(table)
    return matched(spark.table(table))


def matched(df: DataFrame) -> DataFrame:
    """df, whose joins are sorted merges. The planner guesses sizes from the files' bytes and column types, and takes rows that were exploded or
    lengthened for a few megabytes to broadcast; these would all go through the driver. Where one side is small by its nature, the join says broadcast."""
    return df.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
