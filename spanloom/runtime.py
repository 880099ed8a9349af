"""Session plumbing shared by every module: worker import path, table access and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package when the executors see the same code folder."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has, where a row costs far more than its bytes in a file tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parts_for(rows: int, spark: SparkSession, each: int = 400_000) -> int:
    """Into how many parts so many rows go, for a task to hold about ``each`` at any size; one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one on a single machine; on a cluster
    that folder would be another on each, so there must be one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it can be deleted once the result that reads it is written."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffled(rows: DataFrame) -> DataFrame:
    """rows for joins that shuffle. Spark takes the bytes of a table's files for those of its rows; where texts or counts repeat,
    compressed files are a hundredth of them, and a join would send all rows through the driver."""
    return rows.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that later steps neither recompute it nor depend on an executor's disk."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
