"""The brand registry: who sells where, what is new, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.web import authority_of, brand_from_domain
from loomline.operators.dedup import first_wins
from loomline.operators.substring import containing
from loomline.staging import stage


def served_countries() -> Column:
    """Primary country first, then the others a brand ships to."""
    return F.array_distinct(F.concat(F.array("primary_country"), F.col("also_ships_to")))


def brands_for_country(registry: DataFrame, country: str) -> DataFrame:
    code = country.upper()
    return registry.where(
        (F.col("primary_country") == code) | F.array_contains("also_ships_to", code)
    )


def brand_names(registry: DataFrame, country: str | None = None) -> DataFrame:
    """Names in order, of all brands or of those serving a country."""
    rows = registry if country is None else brands_for_country(registry, country)
    return rows.select("name").orderBy("name")


def brand_countries(registry: DataFrame, supported: DataFrame) -> DataFrame:
    """One row per brand and supported country it serves."""
    served = registry.withColumn("country", F.explode(served_countries()))
    return served.join(supported.select("country"), "country", "left_semi")


def brands_per_country(registry: DataFrame, supported: DataFrame) -> DataFrame:
    """Brands per supported country, countries without a brand included."""
    counts = (
        registry.select(F.explode(served_countries()).alias("country"))
        .groupBy("country").agg(F.count(F.lit(1)).alias("brands"))
    )
    return (
        supported.select("country").join(counts, "country", "left")
        .withColumn("brands", F.coalesce("brands", F.lit(0)))
    )


def register_new(registry: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """The registry with incoming brands whose address it does not hold yet."""
    added = first_wins(incoming, ["base_url"], order).select(
        "name", "base_url", F.upper("primary_country").alias("primary_country"),
        F.coalesce("also_ships_to", F.array().cast("array<string>")).alias("also_ships_to"),
        F.coalesce("currency", F.lit(rules.FALLBACK_CURRENCY)).alias("currency"),
        F.coalesce("platform", F.lit("shopify")).alias("platform"),
    )
    return registry.unionByName(added.join(registry.select("base_url"), "base_url", "left_anti"))


def country_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for c, name, _ in rules.COUNTRIES for x in (c, name)])
    return F.coalesce(F.try_element_at(names, F.upper(code)), F.lit(rules.UNKNOWN_COUNTRY))


def country_currency(code: Column) -> Column:
    money = F.create_map(*[F.lit(x) for c, _, m in rules.COUNTRIES for x in (c, m)])
    return F.coalesce(F.try_element_at(money, F.upper(code)), F.lit(rules.FALLBACK_CURRENCY))


def contained_in(names: DataFrame, name: str, texts: DataFrame, text: str) -> DataFrame:
    """The `names` that are a substring of at least one of the `texts`, distinct."""
    wanted = names.select(F.col(name).alias("key"), F.array(name).alias("parts")).where(
        F.col("key").isNotNull()).distinct()
    return containing(wanted, texts, text).select(F.col("key").alias(name)).distinct()


def host_suffixes(url: Column) -> Column:
    """The host of an address and what follows each of its dots."""
    labels = F.split(authority_of(url), r"\.")
    return F.transform(labels, lambda _, at: F.array_join(F.slice(labels, at + 1, F.size(labels)), "."))


def missing_brands(outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry entries for working domains that no registered address contains.

    Most domains are found as a host or its ending, by equality; only what is left over is
    looked for inside the addresses.
    """
    working = stage(outcomes.where(F.col("success") == 1), "working")
    endings = registry.select(F.explode(host_suffixes(F.col("base_url"))).alias("domain"))
    open_ones = stage(working.join(endings, "domain", "left_anti"), "open-domains")
    inside = contained_in(open_ones, "domain", registry, "base_url")
    country = F.coalesce(F.nullif("country", F.lit("")), F.lit(rules.FALLBACK_COUNTRY))
    return open_ones.join(inside, "domain", "left_anti").select(
        brand_from_domain(F.col("domain")).alias("name"),
        F.concat(F.lit("https://"), F.col("domain")).alias("base_url"),
        F.upper(country).alias("primary_country"),
        F.array().cast("array<string>").alias("also_ships_to"),
        country_currency(country).alias("currency"),
        F.lit("shopify").alias("platform"),
    )
