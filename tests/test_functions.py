from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.functions import listing, text, web


def applied(spark, values, function, kind="string"):
    """`function` over a column of hand-made values."""
    rows = [(at, value) for at, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"at int, value {kind}")
    shown = frame.select("at", function(F.col("value")).alias("out")).orderBy("at")
    return [row.out for row in shown.collect()]


@pytest.mark.parametrize("title, category, word_category", [
    ("Soft Sweatshirt", "t-shirt", "sweatshirt"),
    ("Graphic Tee", "t-shirt", "t-shirt"),
    ("Hooded Jacket", "hoodie", "hoodie"),
    ("What a Lamp", "hat", "other"),
    ("Oxford Button-Down", "shirt", "shirt"),
    ("Plain Lamp", "other", "other"),
])
def test_categories(spark, title, category, word_category):
    assert applied(spark, [title], listing.categorize) == [category]
    assert applied(spark, [title], lambda c: listing.categorize(c, "word")) == [word_category]


def test_gender_spellings(spark):
    values = [" MENS ", None, "kids", "Ladies", "f", "unisex", "\tmen"]
    assert applied(spark, values, listing.normalize_gender) == [
        "male", "unisex", "unisex", "female", "female", "unisex", "unisex"]
    with_tabs = applied(spark, values, lambda c: listing.normalize_gender(c, text.WHITESPACE))
    assert with_tabs[-1] == "male"


def test_gender_signals(spark):
    rows = [
        ("Tee", "https://x.example/womens-tee", "other", "female"),
        ("Tee", "https://x.example/mens-tee", "other", "male"),
        ("Tee", "https://menswear.example/p", "other", "male"),
        ("Tee", "https://x.example/men/ladies-tee", "other", "female"),
        ("Tee", "https://x.example/men/young-ladies-tee", "other", "unisex"),
        ("Womens Tee", "https://x.example/p", "other", "female"),
        ("Man Tee", "https://x.example/p", "other", "male"),
        ("Panty", "https://x.example/p", "other", "unisex"),
        ("Long One", "https://x.example/p", "kurta", "female"),
        (None, "https://x.example/p", None, "unisex"),
    ]
    frame = spark.createDataFrame(rows, "title string, url string, category string, want string")
    got = listing.infer_gender(F.col("title"), F.col("url"), F.col("category"))
    wrong = frame.withColumn("got", got).where("got <> want").collect()
    assert wrong == []


def test_sizes(spark):
    values = ["32W", "10.5", "M/L", "M", " one size ", "blue", "", None, "W", "30/32"]
    assert applied(spark, values, listing.is_size) == [
        True, True, False, True, True, False, False, False, False, True]


def test_price_text(spark):
    values = ["1,299.00", "12,50", "12d", "0x1p3", "ask", "", None, " 7 ", "1e2"]
    assert applied(spark, values, listing.price_text) == [
        1299.0, 1250.0, None, None, None, None, None, 7.0, 100.0]


def test_stock(spark):
    values = ["https://schema.org/OutOfStock", "Out of Stock", "InStock", None]
    assert applied(spark, values, listing.in_stock) == [False, False, True, True]


def test_links_and_domains(spark):
    urls = ["http://www.a.com:80/x", "HTTPS://b.co.uk?q=1", "no address"]
    assert applied(spark, urls, web.domain_of) == ["a.com:80", "b.co.uk", ""]
    assert applied(spark, urls[:2], web.base_url_of) == ["http://www.a.com:80", "https://b.co.uk"]
    names = ["1947clothing.com", "the-good-shop.example", "o'neill.com"]
    assert applied(spark, names, web.brand_from_domain) == [
        "1947Clothing", "The Good Shop", "O'Neill"]
    assert applied(spark, ["climbing.com", "loom.com"], web.is_generic) == [True, False]


def test_redirects_before_anchors(spark):
    wrapped = "<a href='/l/?uddg=https%3A%2F%2Fa.com%2Fx%2By+z&amp;r=1'>"
    direct = '<a class="r" href="https://b.com/shop">'
    assert applied(spark, [wrapped + direct, direct], web.result_links) == [
        ["https://a.com/x+y+z"], ["https://b.com/shop"]]


def test_stored_lists(spark):
    values = ['["a", "b"]', '"a"', "7", "a, b ,,c", "", None, "[]"]
    assert applied(spark, values, text.parse_list) == [
        ["a", "b"], ["a"], ["7"], ["a", "b", "c"], [], [], []]
    assert applied(spark, [["a"], None], text.as_json_list, "array<string>") == ['["a"]', "[]"]


def test_words_fold_and_phrases(spark):
    assert applied(spark, ["Café men's T-Shirt", None], text.words) == [
        ["cafe", "men", "s", "t", "shirt"], []]
    assert text.query_phrases("Café men's t-shirt !!") == [
        ("cafe",), ("men", "s"), ("t",), ("shirt",)]
    count = applied(spark, [["a", "b", "a", "b"], ["a"]],
                    lambda c: text.occurrences(c, ("a", "b")), "array<string>")
    assert count == [2, 0]


def test_money(spark):
    frame = spark.createDataFrame([(5.0, "GBP"), (2.5, "USD"), (1.0, "SEK")], "p double, c string")
    shown = frame.select(
        listing.format_price(F.col("p"), F.col("c")).alias("long"),
        listing.card_price(F.col("p"), F.col("c")).alias("card"),
    ).collect()
    assert [(row.long, row.card) for row in shown] == [
        ("£5.00", "GBP5.00"), ("$2.50", "$2.50"), ("SEK 1.00", "SEK1.00")]
