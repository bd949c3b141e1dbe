"""Expressions over addresses, domains and page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomline import rules
from loomline.functions.text import title_case

AUTHORITY = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)"


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 2)


def base_url_of(url: Column) -> Column:
    """Scheme and host, the port kept."""
    return F.concat(F.lower(F.regexp_extract(url, AUTHORITY, 1)), F.lit("://"), authority_of(url))


def domain_of(url: Column) -> Column:
    """Host without any `www.`, the port kept."""
    return F.replace(authority_of(url), F.lit("www."), F.lit(""))


def is_domain(domain: Column) -> Column:
    return F.contains(domain, F.lit("."))


def is_generic(domain: Column) -> Column:
    """The name of a marketplace or portal occurs anywhere in the domain."""
    return domain.rlike("|".join(rules.GENERIC_SITES))


def country_tld(country: Column) -> Column:
    code = F.upper(country)
    tlds = F.create_map(*[F.lit(x) for pair in rules.COUNTRY_TLDS.items() for x in pair])
    return F.coalesce(F.try_element_at(tlds, code), F.lower(country))


def domain_features(domain: Column, country: Column) -> dict[str, Column]:
    """The five integer features the outcome model learns from."""
    name = F.lower(domain)
    labels = F.split(name, r"\.")
    ending = F.element_at(labels, -1)
    return {
        "url_length": F.length(name),
        "is_com": (ending == "com").cast("int"),
        "is_country_tld": (ending == country_tld(country)).cast("int"),
        "has_shop": name.rlike("|".join(rules.SHOP_WORDS)).cast("int"),
        "subdomain_depth": F.array_size(labels),
    }


def brand_from_domain(domain: Column) -> Column:
    """Display name: the first label, hyphens as blanks, title case."""
    label = F.element_at(F.split(domain, r"\."), 1)
    return title_case(F.replace(label, F.lit("-"), F.lit(" ")))


def links(html: Column, pattern: str) -> Column:
    """First group of every match of `pattern` in a page."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def percent_decoded(text: Column) -> Column:
    """Undo percent escapes; a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def result_links(html: Column) -> Column:
    """Result addresses of a search page: unwrapped redirects, else direct anchors."""
    wrapped = F.filter(
        F.transform(links(html, rules.WRAPPED_LINK_PATTERN), percent_decoded),
        lambda link: link.isNotNull(),
    )
    direct = links(html, rules.DIRECT_LINK_PATTERN)
    return F.when(F.array_size(wrapped) > 0, wrapped).otherwise(direct)
