"""The shared folder for intermediate tables.

The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
setting gets a folder of its own; on a cluster its absence is an error, because a
machine-local folder would not survive the loss of the machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class SharedFolderError(RuntimeError):
    """No folder that every executor can reach is configured."""


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise SharedFolderError(f"set {SETTING} to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tontine/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and return it as a scan.

    Cuts lineage where several passes follow (fit, then score): unlike a cache it survives
    lost executors without recomputing, and unlike an RDD checkpoint later passes read
    only the columns and partitions they need.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if partition_by:
        # Rebalancing gathers a partition value's rows and lets adaptive execution split a
        # value that holds too many, so neither tiny files nor one huge task result.
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
