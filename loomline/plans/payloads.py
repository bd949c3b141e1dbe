"""Queries that read listings out of messages, payloads and pages.

Inputs are written from the given tables in the source's own format, read back
by the operator, and checked against the columns they came from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import candidates
from loomline.plans.enrich import category_sql, gender_sql
from loomline.plans.fixtures import GARMENTS_SQL, garments, listings, table, LISTINGS_SQL
from loomline.sources import pages, payloads, tables, topic
from loomline.staging import scratch_path

EVENT = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
HREF = 'href="([^"]+)"'


def decode_json(spark, sf_dir):
    """Events as JSON with an unknown field, one in a hundred unreadable or mistyped."""
    events = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_type") == "error", F.col("value").cast("string"))
        .otherwise(F.lit(None)).alias("noise"),
        "value", "props",
    ))
    wrong = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"),
                     F.lit(', "event_type": "late", "value": "many"}'))
    value = F.when(F.col("value") > 60, F.lit("not json")).when(
        F.col("value") > 40, wrong
    ).otherwise(record)
    return topic.decode(events.select(value.alias("value")), EVENT)


def publish_json(spark, sf_dir):
    """Listings as messages and back."""
    back = topic.decode(topic.encode(listings(spark, sf_dir)))
    return back.select(
        "brand", "title", "price", "currency", "url", "image_url", "category", "available",
        "country", "gender", "description",
        F.array_join("sizes", "|").alias("sizes"), F.array_join("colors", "|").alias("colors"),
    )


def json_export(spark, sf_dir):
    path = scratch_path(spark, "export-json")
    rows = listings(spark, sf_dir).select("id", "title", "price", "url", "sizes", "available")
    tables.write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.withColumn("sizes", F.array_join("sizes", "|"))


def csv_export(spark, sf_dir):
    path = scratch_path(spark, "export-csv")
    rows = listings(spark, sf_dir)
    tables.write_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema(
        tables.export_flat(rows).schema
    ).csv(path).withColumn("url", F.coalesce("url", F.lit("")))


def catalogue_payload(spark, sf_dir):
    """Parts as payload pages: two or three variants, some without readable prices."""
    price = F.col("p_retailprice")

    def variant(amount, option, stocked):
        return F.struct(amount.cast("string").alias("price"), option.alias("option1"),
                        stocked.alias("available"))

    cheap = F.when(F.col("p_type") == "PROMO", F.lit("ask")).otherwise(price.cast("string"))
    dear = F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise((price + 100).cast("string"))
    variants = F.array(
        variant(dear, F.col("p_size").cast("string"), F.col("p_size") > 40),
        variant(cheap, F.lit(" XL "), F.lit(False)),
        variant(dear, F.lit("blue"), F.col("p_type") == "LARGE"),
    )
    options = F.array(
        F.struct(F.lit("Size").alias("name"), F.array(F.lit("XL")).alias("values")),
        F.struct(F.lit("Main Colour").alias("name"),
                 F.array(F.split("title", " ")[0], F.lit("")).alias("values")),
    )
    product = F.struct(
        F.concat(F.lit(" "), F.col("title"), F.lit("\n")).alias("title"),
        F.col("p_partkey").cast("string").alias("handle"),
        F.when(F.col("p_type") == "SMALL", F.array().cast(
            "array<struct<price:string,option1:string,available:boolean>>"
        )).otherwise(variants).alias("variants"),
        F.when(F.col("p_type") != "MEDIUM", options).alias("options"),
        F.array(F.struct(F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string"))
                         .alias("src"))).alias("images"),
    )
    sent = garments(spark, sf_dir).select(
        F.col("p_brand").alias("brand"), F.lit("https://shop.example/").alias("base_url"),
        F.lit("GBP").alias("currency"), F.lit("GB").alias("country"),
        F.to_json(F.struct(F.array(product).alias("products"))).alias("payload"),
    )
    return shown(payloads.listings_from_payload(sent))


def shown(listings_read):
    return listings_read.withColumns({
        "sizes": F.array_join("sizes", "|"), "colors": F.array_join("colors", "|"),
    }).select(
        "brand", "title", "price", "currency", "url", "image_url", "sizes", "colors",
        "category", "available", "country", "gender",
    )


def jsonld_products(spark, sf_dir):
    """Parts as pages whose blocks are a list, a graph, or one entry, with noise around."""
    price = F.col("p_retailprice").cast("string")
    kind = F.col("p_type")
    offers = (
        F.when(kind == "LARGE", F.concat(F.lit('[{"price": "1,'), price, F.lit('", "priceCurrency": "EUR"}, {"price": 1}]')))
        .when(kind == "SMALL", F.concat(F.lit('{"price": 0, "lowPrice": '), price, F.lit(', "availability": "https://schema.org/OutOfStock"}')))
        .when(kind == "PROMO", F.lit('{"price": ""}'))
        .otherwise(F.concat(F.lit('{"price": '), price, F.lit(', "availability": "InStock"}')))
    )
    image = (
        F.when(kind == "LARGE", F.lit('["https://i.example/1", "https://i.example/2"]'))
        .when(kind == "SMALL", F.lit('{"url": "https://i.example/3"}'))
        .otherwise(F.lit('"https://i.example/4"'))
    )
    entry = F.concat(
        F.lit('{"@type": '), F.when(kind == "MEDIUM", F.lit('["Thing", "Product"]')).otherwise(F.lit('"Product"')),
        F.lit(', "name": "'), F.col("title"), F.lit(' ", "url": "/p/'), F.col("p_partkey").cast("string"),
        F.lit('", "image": '), image, F.lit(', "offers": '), offers, F.lit("}"),
    )
    other = F.lit('{"@type": "Organization", "name": "x", "offers": {"price": 5}}')
    block = (
        F.when(kind == "LARGE", F.concat(F.lit("["), other, F.lit(", 5, "), entry, F.lit("]")))
        .when(kind == "MEDIUM", F.concat(F.lit('{"@graph": ['), other, F.lit(","), entry, F.lit("]}")))
        .otherwise(entry)
    )
    html = F.concat(
        F.lit("<html><script type='application/ld+json'>{broken</script><SCRIPT id=1 type=\"application/ld+json\" >\n"),
        block, F.lit("\n</SCRIPT><script>var x = 1;</script></html>"),
    )
    sent = garments(spark, sf_dir).select(
        F.col("p_brand").alias("brand"), F.lit("https://shop.example/").alias("base_url"),
        F.lit("GBP").alias("currency"), F.lit("GB").alias("country"), html.alias("html"),
    )
    return shown(pages.listings_from_pages(sent))


def extract_links(spark, sf_dir):
    found = candidates.extract_links(table(spark, sf_dir, "pages"), HREF)
    return found.select("page_id", "link").groupBy("page_id", "link").agg(
        F.count(F.lit(1)).alias("n"))


def result_links(spark, sf_dir):
    """Pages as search results: redirects with escaped addresses, or plain anchors."""
    escaped = F.concat(F.lit("<a href='/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=1'>x</a>"))
    plain = F.concat(F.lit('<a class="r" href="'), F.split("url", "&")[0], F.lit('">x</a>'))
    page = F.when(F.length("html") > 4000, escaped).otherwise(plain)
    sent = table(spark, sf_dir, "pages").select("page_id", page.alias("html"))
    return candidates.result_links(sent).select("page_id", "url")


QUERIES = {
    f.__name__: f for f in (
        decode_json, publish_json, json_export, csv_export, catalogue_payload, jsonld_products,
        extract_links, result_links,
    )
}

ORACLE = {
    "decode_json": """SELECT CASE WHEN value > 60 THEN NULL ELSE event_id END AS event_id,
        CASE WHEN value > 40 THEN NULL ELSE user_id END AS user_id,
        CASE WHEN value > 60 THEN NULL WHEN value > 40 THEN 'late' ELSE event_type END AS event_type,
        CASE WHEN value > 40 THEN NULL ELSE value END AS value,
        CASE WHEN value > 40 THEN NULL ELSE props END AS props FROM events""",
    "publish_json": f"""WITH {LISTINGS_SQL} SELECT brand, title, price, currency, url, image_url, category,
        available, country, gender, description, size AS sizes, color AS colors FROM L""",
    "json_export": f"WITH {LISTINGS_SQL} SELECT id, title, price, url, size AS sizes, available FROM L",
    "csv_export": f"""WITH {LISTINGS_SQL} SELECT brand, title, price, currency, category, available,
        size AS sizes, color AS colors, country, url, image_url FROM L""",
    "catalogue_payload": f"""WITH {GARMENTS_SQL}, K AS (
          SELECT *, {category_sql("title")} AS category,
            concat('https://shop.example/products/', CAST(p_partkey AS VARCHAR)) AS link
          FROM G WHERE p_type NOT IN ('PROMO', 'SMALL'))
        SELECT p_brand AS brand, title, round(p_retailprice, 2) AS price, 'GBP' AS currency, link AS url,
          concat('https://img.example/', CAST(p_partkey AS VARCHAR)) AS image_url,
          concat(CAST(p_size AS VARCHAR), '|XL') AS sizes,
          CASE WHEN p_type = 'MEDIUM' THEN 'Default' ELSE split_part(title, ' ', 1) END AS colors,
          category, p_size > 40 OR p_type = 'LARGE' AS available, 'GB' AS country,
          {gender_sql("title", "link", "category")} AS gender FROM K""",
    "jsonld_products": f"""WITH {GARMENTS_SQL}, K AS (
          SELECT *, {category_sql("concat(title, ' ')")} AS category,
            concat('https://shop.example/p/', CAST(p_partkey AS VARCHAR)) AS link
          FROM G WHERE p_type <> 'PROMO')
        SELECT p_brand AS brand, title,
          CASE WHEN p_type = 'LARGE' THEN TRY_CAST(concat('1', CAST(p_retailprice AS VARCHAR)) AS DOUBLE)
            ELSE p_retailprice END AS price,
          CASE WHEN p_type = 'LARGE' THEN 'EUR' ELSE 'GBP' END AS currency, link AS url,
          concat('https://i.example/', CASE p_type WHEN 'LARGE' THEN '1' WHEN 'SMALL' THEN '3' ELSE '4' END) AS image_url,
          'See site' AS sizes, 'See site' AS colors, category, p_type <> 'SMALL' AS available,
          'GB' AS country, {gender_sql("title", "link", "category")} AS gender FROM K""",
    "extract_links": f"""WITH T AS (
          SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages)
        SELECT page_id, link, count(*) AS n FROM T GROUP BY page_id, link""",
    "result_links": """SELECT page_id, CASE WHEN length(html) > 4000 THEN url
        ELSE split_part(url, '&', 1) END AS url FROM pages""",
}
