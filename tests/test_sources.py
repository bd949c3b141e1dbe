from __future__ import annotations

import json

from loomline.sources import pages, payloads, topic


def test_decode_tolerates_bad_messages(spark):
    sent = [
        '{"url": "u", "price": 3, "extra": 1, "sizes": ["S"]}',
        '{"url": "v", "price": "12.5", "sizes": "M", "available": 1}',
        "not json",
    ]
    frame = spark.createDataFrame([(value,) for value in sent], "value string")
    rows = topic.decode(frame).collect()
    assert [(r.url, r.price, r.sizes, r.available) for r in rows] == [
        ("u", 3.0, ["S"], None), ("v", None, None, None), (None, None, None, None)]


def read_payload(spark, *products):
    page = json.dumps({"products": list(products)})
    frame = spark.createDataFrame(
        [(page, "B", "https://b.example/", "USD", "US"), ("<html>", "B", "https://b.example", "USD", "US")],
        "payload string, brand string, base_url string, currency string, country string")
    return {row.title: row for row in payloads.listings_from_payload(frame).collect()}


def test_payload_products(spark):
    rows = read_payload(
        spark,
        {"title": " Wool Coat\n", "handle": "wool", "images": [{"src": "i1"}, {"src": "i2"}],
         "options": [{"name": "Size", "values": ["S"]}, {"name": "COLOUR", "values": ["red", "", None]},
                     {"name": "color 2", "values": ["x"]}],
         "variants": [{"price": "20.00", "option1": " M ", "available": False},
                      {"price": "bad", "option1": "red"}, {"price": 15.5, "option1": "M", "available": True}]},
        {"title": None, "variants": [{"price": "1,000"}, {"price": "7"}]},
        {"title": "no variants", "variants": []},
        {"title": "no price", "variants": [{"price": None}, {"price": "ask"}]},
    )
    assert set(rows) == {"Wool Coat", "Untitled"}
    coat, plain = rows["Wool Coat"], rows["Untitled"]
    assert (coat.price, coat.sizes, coat.colors, coat.available) == (15.5, ["M"], ["red"], True)
    assert (coat.url, coat.image_url, coat.category) == ("https://b.example/products/wool", "i1", "jacket")
    assert (plain.price, plain.sizes, plain.colors, plain.available, plain.image_url) == (
        7.0, ["One Size"], ["Default"], False, "")


def read_page(spark, *blocks):
    html = "".join(f"<script type='application/ld+json'>{block}</script>" for block in blocks)
    frame = spark.createDataFrame(
        [(html, "B", "https://b.example/", "USD", "US")],
        "html string, brand string, base_url string, currency string, country string")
    return {row.title: row for row in pages.listings_from_pages(frame).collect()}


def entry(name, **fields):
    return {"@type": "Product", "name": name, **fields}


def test_page_products(spark):
    rows = read_page(
        spark, "{broken", json.dumps([1, "x", entry("list", offers={"price": "1,299.00"})]),
        json.dumps({"@graph": [entry("graph", offers=[{"price": 5}, {"price": 1}], image=["a", "b"]),
                               {"@type": "Brand", "name": "other", "offers": {"price": 1}}]}),
        json.dumps({**entry("typed", offers={"price": 0, "lowPrice": "8", "priceCurrency": "EUR",
                                             "availability": "https://schema.org/Out Of/Stock"},
                            image={"url": "c"}, url="/p/1"), "@type": ["Thing", "Product"]}),
        json.dumps(entry("no offers")), json.dumps(entry("", offers={"price": 1})),
        json.dumps(entry("bad price", offers={"price": "ask"})),
        json.dumps(entry("far", offers={"price": "3", "priceCurrency": ""}, url="http://c.example/x", image="d")),
        json.dumps(entry(7, offers={"price": 1})),
        json.dumps(entry("true price", offers={"price": True})),
        json.dumps(entry("low zero", offers={"price": None, "lowPrice": 0})),
    )
    assert set(rows) == {"list", "graph", "typed", "far", "low zero"}
    assert (rows["list"].price, rows["list"].url, rows["list"].currency) == (1299.0, "https://b.example/", "USD")
    assert (rows["graph"].price, rows["graph"].image_url) == (5.0, "a")
    typed = rows["typed"]
    assert (typed.price, typed.currency, typed.available, typed.image_url, typed.url) == (
        8.0, "EUR", False, "c", "https://b.example/p/1")
    assert (rows["far"].url, rows["far"].currency, rows["far"].image_url) == ("http://c.example/x", "USD", "d")
    assert rows["low zero"].price == 0.0
    assert rows["list"].sizes == ["See site"]
