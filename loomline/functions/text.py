"""Text expressions: folding, tokens, phrases, case, lists."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\v"
WORD = r"[\p{L}\p{N}]+"
BREAK = "\u0000"  # stands between indexed columns so that no phrase crosses them


def _accented_letters() -> tuple[str, str]:
    accented, plain = [], []
    for code in range(0x00C0, 0x0250):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            accented.append(letter)
            plain.append(base.lower())
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accented_letters()


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only the space character."""
    return F.btrim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    """Lower case without diacritics on Latin letters; plain ASCII skips the latter."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.lower(text)
    return F.when(ascii_only, lowered).otherwise(F.translate(lowered, ACCENTED, PLAIN))


def words(text: Column) -> Column:
    """Runs of letters and digits, folded; null text has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """Words of each blank-separated part of a request; a part without words is void."""
    phrases = []
    for part in query.replace("-", " ").split():
        folded = part.lower().translate(str.maketrans(ACCENTED, PLAIN))
        phrase = tuple(re.findall(r"[^\W_]+", folded))
        if phrase and phrase not in phrases:
            phrases.append(phrase)
    return phrases


def occurrences(tokens: Column, phrase: tuple[str, ...]) -> Column:
    """How often the adjacent words of `phrase` occur in an array of words."""
    if len(phrase) == 1:
        return F.array_size(tokens) - F.array_size(F.array_remove(tokens, phrase[0]))
    span = len(phrase)
    wanted = F.array(*[F.lit(word) for word in phrase])
    starts = F.filter(
        F.sequence(F.lit(1), F.array_size(tokens) - span + 1),
        lambda at: F.slice(tokens, at, span) == wanted,
    )
    return F.when(F.array_size(tokens) >= span, F.array_size(starts)).otherwise(0)


def contains_all(haystack: Column, query: str) -> Column:
    """Every blank-separated part of the request is a substring of `haystack`."""
    parts = query.lower().replace("-", " ").split()
    matched = F.lit(True)
    for part in parts:
        matched = matched & F.contains(haystack, F.lit(part))
    return matched


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, digits included."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def parse_list(text: Column) -> Column:
    """A stored list as an array: JSON list, else JSON scalar, else comma-separated."""
    blank = F.coalesce(text, F.lit("")) == ""
    json = F.try_parse_json(text)
    is_list = F.schema_of_variant(json).startswith("ARRAY")
    items = F.transform(
        F.try_variant_get(json, "$", "array<variant>"),
        lambda item: F.coalesce(F.try_variant_get(item, "$", "string"), F.lit("None")),
    )
    scalar = F.array(F.coalesce(F.try_variant_get(json, "$", "string"), F.lit("None")))
    pieces = F.filter(
        F.transform(F.split(text, ","), strip), lambda piece: piece != ""
    )
    return (
        F.when(blank, F.array().cast("array<string>"))
        .when(json.isNull(), pieces)
        .when(is_list, items)
        .otherwise(scalar)
    )


def as_json_list(items: Column) -> Column:
    """An array as JSON text; a missing array is an empty list."""
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


def array_head(items: Column, count: int, separator: str = ", ", more: str = " …") -> Column:
    """The first `count` items joined, with a marker when some are left out."""
    head = F.array_join(F.slice(items, 1, count), separator)
    return F.concat(head, F.when(F.array_size(items) > count, more).otherwise(""))
