"""A live run beside a cached result: new rows as they land, and progress per brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators.cleaning import usable
from loomline.operators.dedup import first_wins, fresh
from loomline.sources.deltas import append_delta, compact, read_state
from loomline.sources.tables import KEY_BUCKETS, key_bucket, touched
from loomline.sources.topic import ARRIVAL, decode

COMPACT_EVERY = 20


def totals(progress: DataFrame) -> DataFrame:
    return progress.groupBy("brand").agg(F.sum("found").alias("found"), F.sum("new").alias("new"))


def start_live_run(messages: DataFrame, cached: DataFrame, folder: str, checkpoint: str,
                   trigger: dict | None = None, compact_every: int = COMPACT_EVERY,
                   buckets: int = KEY_BUCKETS) -> StreamingQuery:
    """Add the rows of a run whose url `cached` lacks, first arrival of each, in batches.

    Every batch also adds, per brand, how many usable rows it found and how many of them
    were new; a replayed batch writes both anew. `read_live` and `read_progress` give what
    has come so far. A batch reads the buckets of the urls it brings.
    """
    def load(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        order = [name for name in ARRIVAL if name in batch.columns] or ["brand", "title", "price"]
        rows, bucket = usable(batch), key_bucket("url", buckets).alias("bucket")
        new = fresh(first_wins(rows, ["url"], order), cached)
        known = read_state(spark, f"{folder}/rows")
        if known is not None:  # joined by url alone, by which the rows lie already
            known = known.where(F.col("bucket").isin(touched(rows.select(bucket))) & (F.col("epoch") < epoch))
            new = fresh(new, known)
        new = append_delta(new.select("*", bucket), f"{folder}/rows", epoch, by="bucket")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        counted = rows.select("brand", one.alias("found"), none.alias("new")).unionByName(
            new.select("brand", none.alias("found"), one.alias("new")))
        append_delta(totals(counted), f"{folder}/progress", epoch)
        if (epoch + 1) % compact_every == 0:
            compact(spark, f"{folder}/rows", epoch, lambda rows: rows.drop("epoch"), by="bucket")
            compact(spark, f"{folder}/progress", epoch, totals)

    return (
        decode(messages).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )


def read_live(spark: SparkSession, folder: str) -> DataFrame | None:
    rows = read_state(spark, f"{folder}/rows")
    return None if rows is None else rows.drop("bucket", "epoch", *ARRIVAL)


def read_progress(spark: SparkSession, folder: str) -> DataFrame | None:
    """`brand, found, new` of all batches so far."""
    progress = read_state(spark, f"{folder}/progress")
    return None if progress is None else totals(progress)
