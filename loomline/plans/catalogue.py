"""Queries that report on and browse the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.listing import card_price, format_price
from loomline.functions.text import array_head
from loomline.operators import matching, ordinals, reports
from loomline.plans.cleaning import cleaned
from loomline.plans.fixtures import (
    CLEAN_SQL, LISTINGS_SQL, PROBES_SQL, histories, listings, probes, table,
)
from loomline.sources import tables
from loomline.staging import scratch_path, stage

BRAND, COUNTRY = "Brand#7", "NATION_3"
TOTAL_ORDER = ["price", "id", "url", "brand", "title"]
TOTAL_ORDER_SQL = ", ".join(TOTAL_ORDER)


def catalogue_stats(spark, sf_dir):
    return reports.catalogue_stats(listings(spark, sf_dir))


def brand_counts(spark, sf_dir):
    return reports.brand_counts(listings(spark, sf_dir))


def brands_found(spark, sf_dir):
    return reports.brands_found(matching.matching(listings(spark, sf_dir), "red widget"))


def facet_counts(spark, sf_dir):
    return reports.facet_counts(listings(spark, sf_dir))


def facet_filter(spark, sf_dir):
    rows = matching.facet(cleaned(spark, sf_dir), brand=BRAND, gender="female")
    return rows.select("id", "brand", "gender", "url", "price")


def gender_split(spark, sf_dir):
    return reports.gender_split(cleaned(spark, sf_dir)).drop("is_total")


def country_match(spark, sf_dir):
    return matching.in_country(listings(spark, sf_dir), COUNTRY.lower()).select("id", "url", "country")


def search_price_range(spark, sf_dir):
    rows = matching.price_between(matching.available(listings(spark, sf_dir)), 20000.0, 60000.0)
    return matching.matching(rows, "red-ring").select("id", "title", "price", "url")


def match_substring(spark, sf_dir):
    queries = ["red ring", "dg-brand#1", "gizmo", "old old", "nothing-here"]
    catalogue = stage(cleaned(spark, sf_dir), "catalogue")
    index = matching.create_match_index(catalogue, scratch_path(spark, "grams"), buckets=16)
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in queries])).alias("query"))
    rows = matching.matching_indexed(catalogue, index, asked)
    return rows.groupBy("query", "brand").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )


def search_with_total(spark, sf_dir):
    found = matching.search_with_total(
        listings(spark, sf_dir), ["red ring", "blue", "Brand#1 gear"], COUNTRY, 0, 90000.0
    )
    return found.select("query", "rank", "id", "price", "match_total", "page_total")


def result_summary(spark, sf_dir):
    found = matching.search_with_total(
        listings(spark, sf_dir), ["red ring", "blue", "Brand#1 gear"], COUNTRY, 0, 90000.0
    )
    return reports.result_summary(found)


def cheapest_matches(spark, sf_dir):
    rows = matching.cheapest_matches(cleaned(spark, sf_dir), "cold rod")
    return rows.select("id", "brand", "title", "price", "url")


def price_sort(spark, sf_dir):
    """The dearest hundred of a ranked result, the rank kept among equals."""
    rows = matching.search_with_total(listings(spark, sf_dir), ["blue"], COUNTRY, limit=None)
    return matching.sort_results(rows, "high").limit(100).select("rank", "id", "price")


def page_of_results(spark, sf_dir):
    rows = matching.matching(cleaned(spark, sf_dir), "hot")
    shown = ordinals.page(rows, [F.col(name) for name in TOTAL_ORDER], number=3)
    return shown.select(*TOTAL_ORDER)


def page_boundaries(spark, sf_dir):
    """Where every page of the whole clean catalogue begins."""
    rows = cleaned(spark, sf_dir, TOTAL_ORDER).select(*TOTAL_ORDER)
    return ordinals.page_boundaries(rows, TOTAL_ORDER)


def deep_page(spark, sf_dir):
    """The page in the middle of the whole clean catalogue."""
    rows = stage(cleaned(spark, sf_dir, TOTAL_ORDER).select(*TOTAL_ORDER)
                 .repartitionByRange("price").sortWithinPartitions("price"), "by-price")
    boundaries = stage(ordinals.page_boundaries(rows, TOTAL_ORDER), "boundaries")
    return ordinals.seek_page(rows, TOTAL_ORDER, boundaries, boundaries.count() // 2 + 1)


def page_count(spark, sf_dir):
    return ordinals.page_count(matching.matching(cleaned(spark, sf_dir), "hot"))


def result_ordinal(spark, sf_dir):
    numbered = ordinals.number_rows(
        cleaned(spark, sf_dir, TOTAL_ORDER).select(*TOTAL_ORDER), [F.col(name) for name in TOTAL_ORDER]
    )
    return numbered.withColumn("card", ordinals.card_number(F.col("position")))


def group_by_brand(spark, sf_dir):
    """A ranked result in one batch per brand."""
    found = matching.search_with_total(listings(spark, sf_dir), ["blue"], COUNTRY, limit=None)
    batches = reports.brand_batches(found)
    return batches.select("brand", "best_rank", "n_items", "first_id")


def product_view(spark, sf_dir):
    """Stored rows: arrays as JSON text, some images and genders missing."""
    rows = listings(spark, sf_dir).withColumn(
        "gender", F.when(F.col("description") != "", F.col("gender"))
    )
    shown = reports.product_view(tables.arrays_to_json(rows))
    return shown.select(
        "id", "url", "price", "image_url", "category", "available", "gender",
        F.array_join("sizes", "|").alias("sizes"), F.array_join("colors", "|").alias("colors"),
    )


def array_heads(spark, sf_dir):
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", array_head(words, 6).alias("sizes"), array_head(words, 4).alias("colors")
    )


def prices_shown(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "id", "url", format_price(F.col("price"), F.col("currency")).alias("shown"),
        card_price(F.col("price"), F.col("currency")).alias("card"),
    )


def user_history(spark, sf_dir):
    """Distinct queries per user, numbered in order of first use."""
    first = reports.user_history(histories(spark, sf_dir))
    return ordinals.number_rows(first, [F.col("first_used"), F.col("query")], by=["user_id"])


def search_log_count(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("country"), F.col("text").alias("query")
    )
    return reports.search_log_counts(log)


def probe_summary(spark, sf_dir):
    return reports.probe_summary(probes(spark, sf_dir)).drop("is_total")


def run_summary(spark, sf_dir):
    return reports.run_summary(probes(spark, sf_dir))


QUERIES = {
    f.__name__: f for f in (
        catalogue_stats, brand_counts, brands_found, facet_counts, facet_filter, gender_split,
        country_match, search_price_range, match_substring, search_with_total, result_summary,
        cheapest_matches, price_sort, page_of_results, page_boundaries, deep_page, page_count, result_ordinal,
        group_by_brand, product_view, user_history, search_log_count, probe_summary, run_summary,
    )
}
QUERIES["array_head"] = array_heads
QUERIES["format_price"] = prices_shown

HAY = "lower(concat(title, ' ', brand, ' ', color, ' ', category))"


def contains_sql(query: str) -> str:
    parts = query.lower().replace("-", " ").split()
    return " AND ".join(f"contains({HAY}, '{part}')" for part in parts) or "true"


def each_sql(queries: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{query}' AS query, * FROM {source} WHERE {contains_sql(query)}"
        for query in queries
    )


def all_matches_sql(query: str) -> str:
    return f"""{LISTINGS_SQL}, F AS (
        SELECT *, ROW_NUMBER() OVER (ORDER BY id, price, url) AS rank
        FROM L WHERE available AND country = '{COUNTRY}' AND {contains_sql(query)})"""


def totals_sql(queries: list[str], limit: int, high: str) -> str:
    return f"""{LISTINGS_SQL}, V AS (SELECT * FROM L WHERE available AND country = '{COUNTRY}' {high}),
        H AS ({each_sql(queries, "V")}),
        T AS (SELECT *, count(*) OVER (PARTITION BY query) AS match_total,
          ROW_NUMBER() OVER (PARTITION BY query ORDER BY id, price, url) AS rank FROM H),
        F AS (SELECT *, least(match_total, {limit}) AS page_total FROM T WHERE rank <= {limit})"""


SIGN_SQL = """CASE currency WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€'
  WHEN 'CAD' THEN 'C$' WHEN 'AUD' THEN 'A$' WHEN 'PKR' THEN 'Rs.' ELSE concat(currency, ' ') END"""
THREE = ["red ring", "blue", "Brand#1 gear"]

ORACLE = {
    "catalogue_stats": f"""WITH {LISTINGS_SQL} SELECT count(*) AS total_products,
        count(*) FILTER (available) AS available FROM L""",
    "brand_counts": f"WITH {LISTINGS_SQL} SELECT brand, count(*) AS n FROM L GROUP BY brand",
    "brands_found": f"WITH {LISTINGS_SQL} SELECT DISTINCT brand FROM L WHERE {contains_sql('red widget')}",
    "facet_counts": f"""WITH {LISTINGS_SQL} SELECT brand, count(*) AS n, 0 AS is_total FROM L GROUP BY brand
        UNION ALL SELECT 'all', count(*), 1 FROM L""",
    "facet_filter": f"""WITH {CLEAN_SQL} SELECT id, brand, gender, url, price FROM C
        WHERE brand = '{BRAND}' AND gender = 'female'""",
    "gender_split": f"""WITH {CLEAN_SQL} SELECT coalesce(brand, 'all') AS brand, count(*) AS items,
        count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female,
        count(*) FILTER (gender = 'unisex') AS unisex FROM C GROUP BY ROLLUP (brand)""",
    "country_match": f"WITH {LISTINGS_SQL} SELECT id, url, country FROM L WHERE country = '{COUNTRY}'",
    "search_price_range": f"""WITH {LISTINGS_SQL} SELECT id, title, price, url FROM L
        WHERE available AND price BETWEEN 20000 AND 60000 AND {contains_sql('red-ring')}""",
    "match_substring": f"""WITH {CLEAN_SQL}, H AS (
        {each_sql(["red ring", "dg-brand#1", "gizmo", "old old", "nothing-here"], "C")})
        SELECT query, brand, count(*) AS n, min(id) AS first_id FROM H GROUP BY query, brand""",
    "search_with_total": f"""WITH {totals_sql(THREE, 60, "AND price <= 90000")}
        SELECT query, rank, id, price, match_total, page_total FROM F""",
    "result_summary": f"""WITH {totals_sql(THREE, 60, "AND price <= 90000")}
        SELECT query, count(*) AS page_total, max(match_total) AS match_total,
          string_agg(DISTINCT brand, ', ' ORDER BY brand) AS brands_found FROM F GROUP BY query""",
    "cheapest_matches": f"""WITH {CLEAN_SQL} SELECT id, brand, title, price, url FROM C
        WHERE {contains_sql("cold rod")} ORDER BY price, brand, url, id LIMIT 100""",
    "price_sort": f"""WITH {all_matches_sql("blue")}
        SELECT rank, id, price FROM F ORDER BY price DESC, rank LIMIT 100""",
    "page_of_results": f"""WITH {CLEAN_SQL} SELECT {TOTAL_ORDER_SQL} FROM C
        WHERE {contains_sql("hot")} ORDER BY {TOTAL_ORDER_SQL} LIMIT 48 OFFSET 96""",
    "page_boundaries": f"""WITH {CLEAN_SQL}, N AS (SELECT {TOTAL_ORDER_SQL},
          ROW_NUMBER() OVER (ORDER BY {TOTAL_ORDER_SQL}) - 1 AS spot FROM C)
        SELECT spot // 48 + 1 AS page, {TOTAL_ORDER_SQL},
          spot - min(spot) OVER (PARTITION BY {TOTAL_ORDER_SQL}) AS skip FROM N
        QUALIFY spot % 48 = 0""",
    "deep_page": f"""WITH {CLEAN_SQL}, N AS (SELECT {TOTAL_ORDER_SQL},
          (ROW_NUMBER() OVER (ORDER BY {TOTAL_ORDER_SQL}) - 1) // 48 AS page,
          (count(*) OVER () + 47) // 48 AS pages FROM C)
        SELECT {TOTAL_ORDER_SQL} FROM N WHERE page = pages // 2""",
    "page_count": f"""WITH {CLEAN_SQL} SELECT count(*) AS items,
        greatest(CAST(ceil(count(*) / 48e0) AS BIGINT), 1) AS pages FROM C WHERE {contains_sql("hot")}""",
    "result_ordinal": f"""WITH {CLEAN_SQL}, N AS (SELECT {TOTAL_ORDER_SQL},
          ROW_NUMBER() OVER (ORDER BY {TOTAL_ORDER_SQL}) AS position FROM C)
        SELECT *, CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0')
          ELSE CAST(position AS VARCHAR) END AS card FROM N""",
    "group_by_brand": f"""WITH {all_matches_sql("blue")}
        SELECT brand, min(rank) AS best_rank, count(*) AS n_items, arg_min(id, rank) AS first_id
        FROM F GROUP BY brand""",
    "product_view": f"""WITH {LISTINGS_SQL}
        SELECT id, url, price, coalesce(image_url, '') AS image_url, category, available,
          CASE WHEN description <> '' THEN gender ELSE 'unisex' END AS gender,
          size AS sizes, color AS colors FROM L""",
    "array_head": """WITH W AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
        SELECT doc_id,
          concat(array_to_string(w[1:6], ', '), CASE WHEN len(w) > 6 THEN ' …' ELSE '' END) AS sizes,
          concat(array_to_string(w[1:4], ', '), CASE WHEN len(w) > 4 THEN ' …' ELSE '' END) AS colors
        FROM W""",
    "format_price": f"""WITH {LISTINGS_SQL} SELECT id, url,
        concat({SIGN_SQL}, printf('%.2f', price)) AS shown,
        concat(CASE currency WHEN 'USD' THEN '$' ELSE currency END, printf('%.2f', price)) AS card FROM L""",
    "user_history": """WITH H AS (SELECT conv_id AS user_id, text AS query, min(turn) AS first_used
          FROM conversations WHERE role = 'user' GROUP BY conv_id, text)
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY first_used, query) AS position FROM H""",
    "search_log_count": """SELECT role AS country, count(*) AS searches,
        count(DISTINCT text) AS queries FROM conversations GROUP BY role""",
    "probe_summary": f"""WITH {PROBES_SQL} SELECT coalesce(country, 'all') AS country, count(*) AS total,
        count(*) FILTER (ok) AS working, CAST(sum(items_seen) AS BIGINT) AS items,
        count(*) FILTER (NOT ok) AS failing FROM P GROUP BY ROLLUP (country)""",
    "run_summary": f"""WITH {PROBES_SQL} SELECT count(*) FILTER (ok AND items_seen > 0) AS brands_ok,
        count(*) FILTER (NOT (ok AND items_seen > 0)) AS brands_skipped,
        CAST(coalesce(sum(items_seen) FILTER (ok), 0) AS BIGINT) AS items FROM P""",
}
