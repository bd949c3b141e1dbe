"""Filters a catalogue is browsed with, and substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.listing import searchable
from loomline.functions.text import contains_all
from loomline.operators.dedup import topk_per
from loomline.operators.ordinals import number_rows
from loomline.operators.substring import Grams, create_grams, search_grams
from loomline.staging import stage


def available(df: DataFrame) -> DataFrame:
    return df.where(F.col("available"))


def in_country(df: DataFrame, country: str) -> DataFrame:
    """Country equality, upper and lower case alike."""
    return df.where(F.upper("country") == country.upper())


def valid_country(df: DataFrame, column: str = "country",
                  supported: list[str] = rules.COUNTRY_CODES) -> DataFrame:
    """Upper-cased codes, unsupported ones dropped."""
    return df.withColumn(column, F.upper(column)).where(F.col(column).isin(supported))


def price_between(df: DataFrame, low: float | None = None,
                  high: float | None = None) -> DataFrame:
    """Inclusive bounds; a bound that is not given does not filter."""
    if low is not None:
        df = df.where(F.col("price") >= low)
    if high is not None:
        df = df.where(F.col("price") <= high)
    return df


def facet(df: DataFrame, brand: str | None = None, gender: str | None = None) -> DataFrame:
    """One brand, one gender; a missing gender counts as unisex."""
    if brand is not None:
        df = df.where(F.col("brand") == brand)
    if gender is not None:
        shown = F.lower(F.coalesce(F.nullif("gender", F.lit("")), F.lit("unisex")))
        df = df.where(shown == gender.lower())
    return df


def haystack() -> Column:
    return searchable(F.col("title"), F.col("brand"), F.col("colors"), F.col("category"))


def matching(df: DataFrame, query: str) -> DataFrame:
    """Rows where every part of the query is a substring; an empty query keeps all."""
    return df.where(contains_all(haystack(), query)) if query.split() else df


def matching_each(df: DataFrame, queries: list[str]) -> DataFrame:
    """Rows with the queries they match, one row per match; one pass, no join."""
    tests = [
        F.when(contains_all(F.col("_haystack"), query), F.lit(query)) for query in queries
    ]
    hits = F.array_compact(F.array(*tests))
    return (
        df.withColumn("_haystack", haystack())
        .withColumn("query", F.explode(hits))
        .drop("_haystack")
    )


def create_match_index(df: DataFrame, path: str, buckets: int = 256) -> Grams:
    """What substring search needs of a catalogue: its different search texts and their grams."""
    return create_grams(df.select(haystack().alias("text")), path, buckets=buckets)


def matching_indexed(df: DataFrame, index: Grams, queries: DataFrame, query: str = "query") -> DataFrame:
    """`matching_each` for a table of queries: only texts with a query's rarest gram are read."""
    parts = F.filter(F.split(F.lower(F.replace(F.col(query), F.lit("-"), F.lit(" "))), r"\s+"),
                     lambda part: part != "")
    wanted = queries.select(F.col(query).alias("key"), parts.alias("parts")).where(
        F.size("parts") > 0).distinct()
    found = stage(search_grams(index, wanted), "matched-texts")
    return df.withColumn("_text", haystack()).join(
        found.select(F.col("key").alias(query), F.col("text").alias("_text")), "_text").drop("_text")


def cheapest_matches(df: DataFrame, query: str = "", limit: int = 100) -> DataFrame:
    """Matching rows, cheapest first, then by brand; url and id settle ties."""
    order = [name for name in ("price", "brand", "url", "id") if name in df.columns]
    return matching(df, query).orderBy(*order).limit(limit)


def sort_results(df: DataFrame, by: str = "relevance") -> DataFrame:
    """Low or high price first with the rank kept on ties, or the rank itself."""
    prices = {"low": [F.asc("price")], "high": [F.desc("price")]}.get(by, [])
    return df.orderBy(*prices, "rank")


def search_with_total(df: DataFrame, queries: list[str], country: str,
                      low: float | None = None, high: float | None = None,
                      limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
    """Substring search over available rows: first rows, page total, full total.

    A bound of zero counts as no bound here. Without a limit every match is ranked,
    by range partitions, and the page is the whole result.
    """
    rows = available(df).where(F.col("country") == country)
    rows = price_between(rows, low or None, high or None)
    hits = matching_each(rows, queries)
    totals = hits.groupBy("query").agg(F.count(F.lit(1)).alias("match_total"))
    order = [F.col("id"), F.col("price"), F.col("url")]
    if limit is None:
        first = number_rows(hits, order, by=["query"], column="rank")
    else:
        first = topk_per(hits, ["query"], order, limit)
    shown = F.col("match_total") if limit is None else F.least("match_total", F.lit(limit))
    return first.join(totals, "query").withColumn("page_total", shown)
