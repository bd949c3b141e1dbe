"""Discovery: from result pages to the domains worth trying next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline import rules
from loomline.functions import web
from loomline.operators.dedup import first_wins, topk_per
from loomline.operators.registry import country_currency, country_name


def extract_links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """One row per match of `pattern` in every page."""
    found = F.posexplode(web.links(F.col(html), pattern)).alias("position", "link")
    return pages.select(*[c for c in pages.columns if c != html], found)


def result_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per result address of every search page."""
    found = F.posexplode(web.result_links(F.col(html))).alias("position", "url")
    return pages.select(*[c for c in pages.columns if c not in (html, "url")], found)


def generic_dropped(domains: DataFrame) -> DataFrame:
    return domains.where(~web.is_generic(F.col("domain")))


def domains_from_urls(urls: DataFrame, order: list[str],
                      within: list[str] | None = None) -> DataFrame:
    """Distinct plausible shop domains, the first address of each kept."""
    named = urls.withColumns({
        "base_url": web.base_url_of(F.col("url")),
        "domain": web.domain_of(F.col("url")),
    })
    plausible = generic_dropped(named.where(web.is_domain(F.col("domain"))))
    return first_wins(plausible, [*(within or []), "domain"], order)


def blocked_skipped(candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates whose last known outcome is not a failure."""
    blocked = latest.where(F.col("success") == 0)
    return candidates.join(blocked.select("domain"), "domain", "left_anti")


def likely(scored: DataFrame, min_probability: float = rules.MIN_SUCCESS_PROBABILITY) -> DataFrame:
    """Rows predicted to work, and rows without a prediction."""
    chance = F.col("probability")
    return scored.where(chance.isNull() | (chance >= min_probability))


def plan_candidates(candidates: DataFrame, latest: DataFrame, max_new: int,
                    scored: DataFrame | None = None) -> DataFrame:
    """The first `max_new` candidates per country that pass every filter.

    Filtered-out candidates do not use up the budget.
    """
    open_ones = blocked_skipped(candidates, latest)
    if scored is not None:
        keys = [name for name in ("country", "domain") if name in scored.columns]
        chances = scored.select(*keys, "probability").dropDuplicates(keys)
        open_ones = likely(open_ones.join(chances, keys, "left"))
    order = [F.col("position"), F.col("domain")]
    return topk_per(open_ones, ["country"], order, max_new, column="turn")


def as_brands(tried: DataFrame, platform: str = "shopify") -> DataFrame:
    """Tried candidates that worked (`success = 1`) as registry entries."""
    return tried.where(F.col("success") == 1).select(
        web.brand_from_domain(F.col("domain")).alias("name"), "base_url",
        F.upper("country").alias("primary_country"),
        F.array().cast("array<string>").alias("also_ships_to"),
        country_currency(F.col("country")).alias("currency"),
        F.lit(platform).alias("platform"),
    )


def discovery_plan(cycles: DataFrame, cycle: str = "cycle",
                   queries: list[str] = rules.DISCOVERY_QUERIES,
                   countries: list[str] = rules.COUNTRY_CODES) -> DataFrame:
    """Every cycle takes the next query of the list, for all countries."""
    wheel = F.array(*[F.lit(query) for query in queries])
    turn = F.pmod(F.col(cycle), F.lit(len(queries))).cast("int")
    planned = cycles.select(
        cycle, F.get(wheel, turn).alias("query"),
        F.explode(F.array(*[F.lit(code) for code in countries])).alias("country"),
    )
    phrase = F.format_string(rules.DISCOVERY_PHRASE, "query", country_name(F.col("country")))
    return planned.withColumn("phrase", phrase)
