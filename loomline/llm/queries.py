"""Registered queries of this package, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import (
    decontam, extract, grace, middle, mixing, negatives, oracles, quality, ring, secrets, simhash,
    toxicity, warc, weighted,
)
from loomline.llm.tables import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicate_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprint_report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_report(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extraction_report(table(spark, sf_dir, "pages"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_report(table(spark, sf_dir, "documents"))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.duplicates_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_shards": op8_shards,
    "op9_main_text": op9_main_text,
    "op10_mixture": op10_mixture,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_warc": oracles.WARC,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op10_mixture": oracles.MIXTURE,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_exact_duplicates": oracles.EXACT_DUPLICATES,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
