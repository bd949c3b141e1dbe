"""Intermediate tables in the folder the cluster shares.

A staged table cuts lineage, survives the loss of any executor, and comes back
with real file sizes, so Catalyst broadcasts it only when it is small enough
(`spark.sql.autoBroadcastJoinThreshold`) and shuffles it otherwise.
"""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CODEC = "zstd"  # for tables that hold a copy of the input
_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters."""
    global _local_folder
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="loomline-")
    return _local_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write `df` once and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)



def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
