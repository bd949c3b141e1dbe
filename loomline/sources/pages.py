"""Web pages with embedded product data (JSON-LD), to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.listing import (
    absolute_url, categorize, in_stock, infer_gender, price_text,
)
from loomline.functions.text import strip
from loomline.functions.web import links


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def _says_something(value: Column) -> Column:
    """Neither missing nor null, false, zero, or empty text."""
    text = _at(value, "$", "string")
    number = F.when(_kind(value) != "STRING", text.try_cast("double"))
    return (
        text.isNotNull() & (text != "")
        & ~((_kind(value) == "BOOLEAN") & (text == "false"))
        & (F.coalesce(number, F.lit(1e0)) != 0)
    )


def embedded_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per `Product` entry of every JSON-LD block; unreadable blocks are skipped.

    A block is a list of entries, a graph of entries, or one entry.
    """
    kept = [name for name in pages.columns if name != html]
    blocks = pages.select(
        *kept, F.explode(links(F.col(html), rules.JSONLD_PATTERN)).alias("_block")
    )
    parsed = blocks.select(*kept, F.try_parse_json(strip(F.col("_block"))).alias("_data"))
    data = F.col("_data")
    graph = _at(data, '$["@graph"]', "array<variant>")
    entries = (
        F.when(_kind(data).startswith("ARRAY"), _at(data, "$", "array<variant>"))
        .when(graph.isNotNull(), graph)
        .otherwise(F.array(data))
    )
    listed = parsed.where(data.isNotNull()).select(*kept, F.explode(entries).alias("entry"))
    entry = F.col("entry")
    typed = (_at(entry, '$["@type"]', "string") == "Product") | F.coalesce(
        F.array_contains(_at(entry, '$["@type"]', "array<string>"), "Product"), F.lit(False)
    )
    return listed.where(_is_object(entry)).where(typed)


def listings_from_pages(pages: DataFrame) -> DataFrame:
    """Listings of pages (`html, brand, base_url, currency, country`).

    An entry needs a name and a readable price. The first offer counts; a price
    that says nothing gives way to the low price.
    """
    entry, offer = F.col("entry"), F.col("_offer")
    offers = _at(entry, "$.offers")
    first_offer = F.when(_is_object(offers), offers).otherwise(
        F.get(_at(entry, "$.offers", "array<variant>"), F.lit(0))
    )
    picked = embedded_products(pages).withColumn("_offer", first_offer)
    price = F.when(
        _says_something(_at(offer, "$.price")), _at(offer, "$.price", "string")
    ).otherwise(_at(offer, "$.lowPrice", "string"))
    image = F.coalesce(F.get(_at(entry, "$.image", "array<variant>"), F.lit(0)),
                       _at(entry, "$.image"))
    image_url = F.when(_is_object(image), _at(image, "$.url", "string")).when(
        _kind(image) == "STRING", _at(image, "$", "string")
    )
    name = F.when(_kind(_at(entry, "$.name")) == "STRING", _at(entry, "$.name", "string"))
    unlisted = F.array(*[F.lit(option) for option in rules.UNLISTED_OPTIONS])
    read = picked.select(
        "brand", "country", name.alias("_name"),
        F.round(price_text(price), 2).alias("price"),
        F.coalesce(F.nullif(_at(offer, "$.priceCurrency", "string"), F.lit("")),
                   F.col("currency")).alias("currency"),
        absolute_url(_at(entry, "$.url", "string"), F.col("base_url")).alias("url"),
        F.coalesce(image_url, F.lit("")).alias("image_url"),
        unlisted.alias("sizes"), unlisted.alias("colors"),
        in_stock(_at(offer, "$.availability", "string")).alias("available"),
    )
    named = read.where((F.col("_name") != "") & F.col("price").isNotNull())
    sorted_in = named.withColumns({
        "category": categorize(F.col("_name")), "title": strip(F.col("_name")),
    }).drop("_name")
    return sorted_in.withColumn(
        "gender", infer_gender(F.col("title"), F.col("url"), F.col("category"))
    )
