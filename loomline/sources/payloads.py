"""Catalogue payloads: pages of nested products, to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.listing import categorize, infer_gender, is_size, number_text
from loomline.functions.text import strip
from loomline.schemas import CATALOGUE_PAGE


def products(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per product of every payload page; a page that is no JSON has none."""
    page = F.from_json(F.col(payload), CATALOGUE_PAGE)
    return pages.select(
        *[name for name in pages.columns if name != payload],
        F.explode(page["products"]).alias("product"),
    )


def _colors(options: Column) -> Column:
    named = F.filter(
        options, lambda option: F.lower(F.coalesce(option["name"], F.lit(""))).rlike("colou?r")
    )
    values = F.filter(
        F.get(named, F.lit(0))["values"], lambda value: F.coalesce(value, F.lit("")) != ""
    )
    return F.when(F.size(values) > 0, values).otherwise(
        F.array(*[F.lit(color) for color in rules.DEFAULT_COLORS])
    )


def _sizes(variants: Column) -> Column:
    shown = F.filter(F.transform(variants, lambda variant: variant["option1"]), is_size)
    distinct = F.array_sort(F.array_distinct(F.transform(shown, strip)))
    return F.when(F.size(distinct) > 0, distinct).otherwise(
        F.array(*[F.lit(size) for size in rules.DEFAULT_SIZES])
    )


def listings_from_payload(pages: DataFrame) -> DataFrame:
    """Listings of payload pages (`payload, brand, base_url, currency, country`).

    A product without variants or without any readable price is dropped; the
    price is the lowest over the variants.
    """
    product = F.col("product")
    variants = product["variants"]
    title = F.coalesce(F.nullif(product["title"], F.lit("")), F.lit(rules.DEFAULT_TITLE))
    read = products(pages).select(
        "brand", "currency", "country",
        strip(title).alias("title"),
        F.array_min(F.transform(variants, lambda v: number_text(v["price"]))).alias("price"),
        F.concat_ws(
            "/products/", F.rtrim(F.col("base_url"), F.lit("/")),
            F.coalesce(product["handle"], F.lit("")),
        ).alias("url"),
        F.coalesce(F.get(product["images"], F.lit(0))["src"], F.lit("")).alias("image_url"),
        _sizes(variants).alias("sizes"),
        _colors(product["options"]).alias("colors"),
        F.coalesce(F.exists(variants, lambda v: F.coalesce(v["available"], F.lit(False))),
                   F.lit(False)).alias("available"),
    )
    priced = read.where(F.col("price").isNotNull()).withColumn("price", F.round("price", 2))
    sorted_in = priced.withColumn("category", categorize(F.col("title")))
    return sorted_in.withColumn(
        "gender", infer_gender(F.col("title"), F.col("url"), F.col("category"))
    )
