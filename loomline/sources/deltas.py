"""State of a stream as a snapshot and the changes since.

Below a folder, every epoch has its changes in `delta/epoch=`, overwritten when the epoch is
replayed. `compact` folds all of them into a snapshot, `base/upto=`, names it in `commits`
last, and deletes what it replaces. Readers open the newest snapshot and later epochs only,
so what they open does not grow with the age of the stream; an epoch that a snapshot already
holds counts for nothing when it is replayed.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.sources.tables import table_or_none
from loomline.staging import CODEC, discard


def append_delta(changes: DataFrame, path: str, epoch: int, by: str | None = None) -> DataFrame:
    """Write the changes of an epoch; a scan of what was written, so that no copy is needed."""
    writer = changes.write.mode("overwrite").option("compression", CODEC)
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/delta/epoch={epoch}")
    return changes.sparkSession.read.schema(changes.schema).parquet(f"{path}/delta/epoch={epoch}")


def snapshot(spark: SparkSession, path: str) -> int:
    """The last epoch that the newest snapshot holds; -1 without one."""
    commits = table_or_none(spark, f"{path}/commits")
    return -1 if commits is None else commits.agg(F.max("upto")).first()[0]


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """Snapshot and later changes with their `epoch`; None before the first."""
    upto = snapshot(spark, path)
    parts = [] if upto < 0 else [
        spark.read.parquet(f"{path}/base/upto={upto}").withColumn("epoch", F.lit(upto).cast("long"))]
    delta = table_or_none(spark, f"{path}/delta")
    if delta is not None:
        parts.append(delta.where(F.col("epoch") > upto).withColumn("epoch", F.col("epoch").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, path: str, epoch: int, fold: Callable[[DataFrame], DataFrame],
            by: str | None = None) -> None:
    """Fold everything up to `epoch` into a new snapshot; `fold` gets the rows with `epoch`."""
    before = snapshot(spark, path)
    if epoch <= before:
        return
    rows = read_state(spark, path)
    if rows is None:
        return
    merged = fold(rows.where(F.col("epoch") <= epoch))
    if by:
        merged = merged.hint("rebalance", by)
    writer = merged.write.mode("overwrite").option("compression", CODEC)
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/base/upto={epoch}")
    spark.range(1).select(F.lit(epoch).cast("long").alias("upto")).write.mode("append").parquet(f"{path}/commits")
    for old in range(before + 1, epoch + 1):
        discard(spark, f"{path}/delta/epoch={old}")
    if before >= 0:
        discard(spark, f"{path}/base/upto={before}")
