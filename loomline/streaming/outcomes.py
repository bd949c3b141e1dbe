"""The continuous fold of site outcomes to the latest state per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators.outcomes import with_features
from loomline.sources.deltas import append_delta, compact, read_state

COMPACT_EVERY = 20


def newest(changes: DataFrame) -> DataFrame:
    """The last state of every domain among changes of several epochs."""
    state = F.struct("country", "success", "attempts", "last_checked")
    last = changes.groupBy("domain").agg(F.max_by(state, "epoch").alias("_state"))
    return last.select("domain", "_state.*")


def start_outcome_fold(log: DataFrame, target: str, checkpoint: str,
                       trigger: dict | None = None,
                       compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the latest state per domain of an outcome stream (`domain, country, success, ts`).

    State is one row per domain. Each batch writes the domains it changed, overwritten on
    replay, so a restart repeats nothing; every so many batches the changes are folded.
    """
    folded = log.groupBy("domain").agg(
        F.min_by("country", "ts").alias("country"),
        F.max_by("success", "ts").alias("success"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("ts").alias("last_checked"),
    )

    def write(batch: DataFrame, epoch: int) -> None:
        append_delta(batch, target, epoch)
        if (epoch + 1) % compact_every == 0:
            compact(batch.sparkSession, target, epoch, newest)

    return (
        folded.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )


def read_outcomes(spark: SparkSession, target: str) -> DataFrame:
    """Latest state per domain: the newest snapshot and the changes after it."""
    return with_features(newest(read_state(spark, target)))
