"""Counts and summaries. Every one is an aggregation with a partial phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.text import parse_list


def count_rows() -> Column:
    return F.count(F.lit(1))


def catalogue_stats(df: DataFrame) -> DataFrame:
    """All rows and available rows."""
    return df.agg(
        count_rows().alias("total_products"),
        F.count_if("available").alias("available"),
    )


def brand_counts(df: DataFrame) -> DataFrame:
    """Rows per brand, largest first."""
    return df.groupBy("brand").agg(count_rows().alias("n")).orderBy(F.desc("n"), "brand")


def brands_found(df: DataFrame) -> DataFrame:
    """Distinct brands in order."""
    return df.select("brand").distinct().orderBy("brand")


def facet_counts(df: DataFrame, column: str = "brand") -> DataFrame:
    """Rows per facet value and over all; the rollup runs on the counts."""
    counts = df.groupBy(column).agg(count_rows().alias("n"))
    return (
        counts.rollup(column)
        .agg(F.sum("n").alias("n"), F.grouping(column).cast("int").alias("is_total"))
        .withColumn(column, F.when(F.col("is_total") == 1, "all").otherwise(F.col(column)))
    )


def gender_split(df: DataFrame) -> DataFrame:
    """Male, female and unisex rows per brand and over all."""
    def spelled(gender: str) -> Column:
        return F.count_if(F.col("gender") == gender).alias(gender)

    split = df.groupBy("brand").agg(
        count_rows().alias("items"), spelled("male"), spelled("female"), spelled("unisex")
    )
    sums = [F.sum(name).alias(name) for name in ("items", "male", "female", "unisex")]
    return (
        split.rollup("brand").agg(*sums, F.grouping("brand").cast("int").alias("is_total"))
        .withColumn("brand", F.when(F.col("is_total") == 1, "all").otherwise(F.col("brand")))
    )


def brand_batches(ranked: DataFrame, score: str = "rank") -> DataFrame:
    """The batches of a ranked result by brand: best rank, size, and the row shown first.

    The rows of a batch are the result's own, ordered by `brand_rows`; no brand is
    gathered into a list.
    """
    return ranked.groupBy("brand").agg(
        F.min(score).alias("best_rank"), count_rows().alias("n_items"),
        F.min_by("id", score).alias("first_id"),
    )


def brand_rows(ranked: DataFrame, score: str = "rank") -> DataFrame:
    """A ranked result's rows, brands in order of their best row, each in rank order."""
    best = ranked.groupBy("brand").agg(F.min(score).alias("best_rank"))
    return ranked.join(best, "brand").orderBy("best_rank", score)


def result_summary(ranked: DataFrame) -> DataFrame:
    """Per query: rows on this page, all matches, brands of the page in order."""
    brands = F.array_join(F.sort_array(F.collect_set("brand")), ", ")
    return ranked.groupBy("query").agg(
        count_rows().alias("page_total"),
        F.max("match_total").alias("match_total"),
        brands.alias("brands_found"),
    )


def probe_summary(probes: DataFrame) -> DataFrame:
    """Working and failing sources per country and over all, with items seen."""
    counts = probes.groupBy("country").agg(
        count_rows().alias("total"), F.count_if("ok").alias("working"),
        F.sum("items_seen").alias("items"),
    )
    sums = [F.sum(name).alias(name) for name in ("total", "working", "items")]
    return (
        counts.rollup("country").agg(*sums, F.grouping("country").cast("int").alias("is_total"))
        .withColumn("failing", F.col("total") - F.col("working"))
        .withColumn("country", F.when(F.col("is_total") == 1, "all").otherwise(F.col("country")))
    )


def probe_results(probes: DataFrame) -> DataFrame:
    """Working sources first, then by name."""
    return probes.orderBy("country", F.desc("ok"), "name")


def run_summary(attempts: DataFrame) -> DataFrame:
    """Sources loaded, sources skipped, items shipped by one load."""
    loaded = F.col("items_seen") > 0
    return attempts.agg(
        F.count_if(F.col("ok") & loaded).alias("brands_ok"),
        F.count_if(~(F.col("ok") & loaded)).alias("brands_skipped"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("items_seen"))), F.lit(0)).alias("items"),
    )


def product_view(stored: DataFrame) -> DataFrame:
    """Stored rows as answered to a client: list text parsed, blanks defaulted."""
    def shown(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    return stored.withColumns({
        "image_url": shown("image_url", ""),
        "sizes": parse_list(F.col("sizes")),
        "colors": parse_list(F.col("colors")),
        "category": shown("category", rules.DEFAULT_CATEGORY),
        "available": F.coalesce("available", F.lit(False)),
        "gender": shown("gender", "unisex"),
    })


def user_history(events: DataFrame, user: str = "user_id", at: str = "ts",
                 query: str = "query") -> DataFrame:
    """Every user's distinct queries with the time of first use.

    One row per user and query rather than an array per user: repeats combine
    map-side, and no user's history has to fit into one task.
    """
    return events.groupBy(user, query).agg(F.min(at).alias("first_used"))


def search_log_counts(log: DataFrame) -> DataFrame:
    """Logged searches per country."""
    return log.groupBy("country").agg(
        count_rows().alias("searches"), F.count_distinct("query").alias("queries")
    )
