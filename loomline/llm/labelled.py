"""Labelled training texts, bounded in number and free of the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.tables import hash_sample
from loomline.staging import stage

FOLDS = 5


def trained_on(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(~trained_on(doc_id), F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """Distinct (text, label) of at most `max_labelled` labelled rows outside the held-out fold.

    The rows are those of least hash of doc_id. Null labels are not used; a document
    labelled twice counts as 1 if one label says so.
    """
    usable = labels.where(F.col(label).isNotNull() & trained_on(F.col("doc_id"))).select(
        "doc_id", F.col(label).cast("int").alias("label"))
    sample = hash_sample(usable, F.col("doc_id"), max_labelled)
    once = stage(sample.groupBy("doc_id").agg(F.max("label").alias("label")), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(once), "doc_id")  # max_labelled rows
    return stage(
        rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").distinct(), "training"
    )
