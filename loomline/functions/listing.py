"""Expressions over the fields of one listing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from loomline import rules
from loomline.functions.text import strip

NUMBER = r"^[ \t\n\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r]*$"


def any_of(text: Column, parts: list[str]) -> Column:
    """`text` contains at least one of `parts`."""
    return reduce(or_, [F.contains(text, F.lit(part)) for part in parts])


def normalize_gender(gender: Column, blanks: str = " ") -> Column:
    """male, female or unisex, whatever the spelling; missing is unisex."""
    spelling = F.btrim(F.lower(gender), F.lit(blanks))
    return (
        F.when(spelling.isin(rules.MALE_SPELLINGS), "male")
        .when(spelling.isin(rules.FEMALE_SPELLINGS), "female")
        .otherwise("unisex")
    )


def categorize(title: Column, mode: str = "substring") -> Column:
    """First category whose keyword occurs in the title.

    `mode="substring"` finds keywords inside longer words as well;
    `mode="word"` wants whole words.
    """
    lowered = F.lower(title)
    chosen = None
    for category, keywords in rules.CATEGORY_KEYWORDS:
        if mode == "word":
            hit = lowered.rlike(r"\b(" + "|".join(k.strip() for k in keywords) + r")\b")
        else:
            hit = any_of(lowered, keywords)
        chosen = F.when(hit, category) if chosen is None else chosen.when(hit, category)
    return chosen.otherwise(rules.DEFAULT_CATEGORY)


def infer_gender(title: Column, url: Column, category: Column) -> Column:
    """Gender from the address, then the title's words, then the category."""
    address = F.lower(url)
    heading = F.coalesce(title, F.lit(""))
    return (
        F.when(any_of(address, rules.FEMALE_URL_HINTS), "female")
        .when(
            any_of(address, rules.MALE_URL_HINTS)
            & ~any_of(address, rules.MALE_URL_VETOES),
            "male",
        )
        .when(heading.rlike("(?i)" + rules.FEMALE_TITLE_PATTERN), "female")
        .when(heading.rlike("(?i)" + rules.MALE_TITLE_PATTERN), "male")
        .when(F.lower(category).isin(rules.FEMALE_CATEGORIES), "female")
        .otherwise("unisex")
    )


def is_size(value: Column) -> Column:
    """A known size name, or a number once waist, length and fraction marks are gone."""
    shown = strip(F.upper(F.coalesce(value, F.lit(""))))
    digits = F.regexp_replace(shown, r"[WL./]", "")
    return shown.isin(rules.SIZE_NAMES) | digits.rlike(r"^\p{Nd}+$")


def number_text(text: Column) -> Column:
    """A plain decimal number, else null (no hexadecimal or type suffixes)."""
    return F.when(text.rlike(NUMBER), F.btrim(text, F.lit(" \t\n\r")).try_cast("double"))


def price_text(text: Column) -> Column:
    """A price as written, thousands separators removed; null when it is no number."""
    return number_text(F.replace(text, F.lit(","), F.lit("")))


def in_stock(availability: Column) -> Column:
    """Anything that does not spell 'out of stock' is in stock, also nothing at all."""
    spelled = F.regexp_replace(F.lower(F.coalesce(availability, F.lit(""))), "[ /]", "")
    return ~F.contains(spelled, F.lit("outofstock"))


def absolute_url(url: Column, base: Column) -> Column:
    """A link made absolute against its site; an empty link is the site itself."""
    return (
        F.when(F.coalesce(url, F.lit("")) == "", base)
        .when(url.startswith("http"), url)
        .otherwise(F.concat_ws("/", F.rtrim(base, F.lit("/")), F.ltrim(url, F.lit("/"))))
    )


def format_price(price: Column, currency: Column) -> Column:
    """Two decimals after the currency's sign, or its code and a space."""
    signs = F.create_map(*[F.lit(x) for pair in rules.CURRENCY_SYMBOLS.items() for x in pair])
    sign = F.coalesce(F.try_element_at(signs, currency), F.concat(currency, F.lit(" ")))
    return F.concat(sign, F.format_string("%.2f", price))


def card_price(price: Column, currency: Column) -> Column:
    """Price on a result card: a dollar sign for USD, the bare code otherwise."""
    sign = F.when(currency == "USD", "$").otherwise(currency)
    return F.concat(sign, F.format_string("%.2f", price))


def searchable(title: Column, brand: Column, colors: Column, category: Column) -> Column:
    """The lower-case text that substring search looks into."""
    return F.lower(
        F.concat_ws(
            " ",
            F.coalesce(title, F.lit("")),
            F.coalesce(brand, F.lit("")),
            F.array_join(F.coalesce(colors, F.array().cast("array<string>")), " "),
            F.coalesce(category, F.lit("")),
        )
    )
