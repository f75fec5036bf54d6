"""The folder that driver and executors share, for tables and files on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where the cluster names none (a local session) is a folder made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_claimloom_shared", None)
    if not made:
        made = spark._claimloom_shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table written to the shared folder, so that they are computed once."""
    at = new_path(rows.sparkSession, name)
    rows.write.parquet(at, compression="zstd")
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scanned table, dealt out by key if its files give fewer tasks than there are cores: texts that
    are costly to process may come in a single small file. Larger tables stay as they are scanned."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
