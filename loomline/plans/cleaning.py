"""Queries over the listing rules and the stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline import rules
from loomline.functions.listing import normalize_gender
from loomline.operators import cleaning, dedup, matching
from loomline.plans.fixtures import (
    CLEAN_SQL, FIRST_SEEN, FIRST_SEEN_SQL, GENDER_SQL, LISTINGS_SQL, listings, table,
)
from loomline.sources import tables
from loomline.staging import stage

SNAPSHOT = "1998-01-01"
SHOWN = ["id", "brand", "title", "price", "currency", "url", "category", "country", "gender"]
SHOWN_SQL = ", ".join(SHOWN)


TIES = ["currency", "image_url", "category", "available"]  # compared before the country
SEEN = ["url", *FIRST_SEEN]  # what tells the first row of a url
PRICE_SEEN = FIRST_SEEN[:3]  # as far as ids and prices depend on it


def cleaned(spark, sf_dir, columns=None):
    return cleaning.clean(listings(spark, sf_dir), order=FIRST_SEEN, columns=columns)


def stored(spark, sf_dir, columns):
    """The stored table: cleaned listings, one per url, the first seen.

    Duplicates share their url, so the first of a url is taken before the duplicate rule: rows
    then lie by url already, and that rule, which has nothing left to drop, shuffles none. The
    colors, words of the title, are compared before the description and the sizes, which stay behind.
    """
    rows = cleaning.usable(listings(spark, sf_dir)).withColumn("gender", normalize_gender(F.col("gender")))
    order = [*FIRST_SEEN, *TIES, "country", "gender", "colors"]
    first = dedup.first_wins(rows, ["url"], order, [*columns, *rules.DUPLICATE_KEYS])
    return dedup.dedup(first).select(*columns)


def clean_rules(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*SHOWN, "description")


def clean_minimal(spark, sf_dir):
    rows = cleaning.clean_minimal(listings(spark, sf_dir))
    return rows.select(*SHOWN, "image_url", F.array_join("sizes", "|").alias("sizes"), "available")


def gender_normalize(spark, sf_dir):
    rows = listings(spark, sf_dir)
    spelled = rows.groupBy("gender").agg(F.count(F.lit(1)).alias("n"))
    return spelled.withColumn("canonical", normalize_gender(F.col("gender")))


def dedup_keys(spark, sf_dir):
    """Every listing twice, the copies under another size and description."""
    rows = listings(spark, sf_dir)
    copies = rows.withColumns({"sizes": F.array(F.lit("XL")), "description": F.lit("copy")})
    distinct = dedup.dedup(rows.unionByName(copies), order=["scraped_at", "id", "sizes"],
                           columns=["id", *rules.DUPLICATE_KEYS, "sizes"])
    return distinct.select("id", *rules.DUPLICATE_KEYS, F.array_join("sizes", "|").alias("sizes"))


def brand_median(spark, sf_dir):
    return cleaning.medians(cleaning.usable(listings(spark, sf_dir)))


def outlier_filter(spark, sf_dir):
    return cleaning.outliers_removed(cleaned_once(spark, sf_dir, SEEN)).select("id", "brand", "title", "price", "url")


def outlier_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return cleaning.outliers_removed(events, "event_type", "value")


def cleaned_once(spark, sf_dir, columns=None):
    """Cleaned listings, written once for queries that use them more than once."""
    return stage(cleaned(spark, sf_dir, columns), "cleaned")


def snapshot(rows, order=FIRST_SEEN):
    """The stored table as of a day: the first row of every url until then."""
    return dedup.first_wins(rows.where(F.col("scraped_at") < SNAPSHOT), ["url"], order)


def insert_if_absent(spark, sf_dir):
    rows = cleaned_once(spark, sf_dir, [*SEEN, *TIES, "country"])
    new = tables.insert_if_absent(rows, snapshot(rows), FIRST_SEEN)
    return new.select("id", "brand", "title", "price", "url", "country")


def fresh_not_cached(spark, sf_dir):
    rows = cleaned_once(spark, sf_dir, SEEN)
    return dedup.fresh(rows, snapshot(rows)).select("id", "url", "price")


def stored_for_batch(spark, sf_dir):
    rows = cleaned_once(spark, sf_dir, SEEN)
    batch = rows.where(F.col("scraped_at") >= SNAPSHOT)
    return dedup.stored_for(batch, snapshot(rows)).select("id", "url", "price")


def cached_union_live(spark, sf_dir):
    rows = cleaned_once(spark, sf_dir, ["url", *PRICE_SEEN])
    union = dedup.cached_then_live(snapshot(rows, PRICE_SEEN), rows, PRICE_SEEN)
    return union.select("id", "url", "price", "cached")


def arrays_to_json(spark, sf_dir):
    return tables.arrays_to_json(listings(spark, sf_dir)).select("id", "url", "price", "sizes", "colors")


def export_flat(spark, sf_dir):
    return tables.export_flat(cleaned(spark, sf_dir))


def available_snapshot(spark, sf_dir):
    return matching.available(listings(spark, sf_dir)).select("id", "url", "price", "title")


def with_defaults(spark, sf_dir):
    """An old outcome table without two later columns."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("domain"))
    return tables.with_defaults(old, {
        "domain": F.lit("never used"), "subdomain_depth": F.lit(2), "country": F.lit(""),
        "attempts": F.lit(1),
    })


def price_refresh(spark, sf_dir):
    """The stored table when the newest row of a url wins instead of the first."""
    rows = cleaned_once(spark, sf_dir, ["url", *PRICE_SEEN])
    later = rows.where(F.col("scraped_at") >= SNAPSHOT)
    refreshed = tables.upsert_latest(later, snapshot(rows, PRICE_SEEN), PRICE_SEEN)
    return refreshed.select("id", "url", "price")


QUERIES = {
    f.__name__: f for f in (
        clean_rules, clean_minimal, gender_normalize, dedup_keys, brand_median, outlier_filter,
        outlier_events, insert_if_absent, fresh_not_cached, stored_for_batch, cached_union_live,
        arrays_to_json, export_flat, available_snapshot, with_defaults, price_refresh,
    )
}

FIRST = f"ROW_NUMBER() OVER (PARTITION BY url ORDER BY {FIRST_SEEN_SQL}) = 1"
SNAPSHOT_SQL = f"""{CLEAN_SQL}, B AS (
  SELECT * FROM C WHERE scraped_at < TIMESTAMP '{SNAPSHOT}' QUALIFY {FIRST})"""

ORACLE = {
    "clean_rules": f"WITH {CLEAN_SQL} SELECT {SHOWN_SQL}, description FROM C",
    "clean_minimal": f"""WITH {LISTINGS_SQL}
        SELECT id, brand, title, price, currency, url, coalesce(nullif(category, ''), 'other') AS category,
          country, {GENDER_SQL} AS gender, coalesce(image_url, '') AS image_url, size AS sizes, available
        FROM L WHERE url <> '' AND price > 0""",
    "gender_normalize": f"""WITH {LISTINGS_SQL}
        SELECT gender, count(*) AS n, {GENDER_SQL} AS canonical FROM L GROUP BY gender""",
    "dedup_keys": f"""WITH {LISTINGS_SQL},
        T AS (SELECT * FROM L UNION ALL SELECT * REPLACE ('XL' AS size, 'copy' AS description) FROM L)
        SELECT id, {", ".join(rules.DUPLICATE_KEYS)}, size AS sizes FROM T
        QUALIFY ROW_NUMBER() OVER (PARTITION BY {", ".join(rules.DUPLICATE_KEYS)}
          ORDER BY scraped_at, id, size) = 1""",
    "brand_median": f"""WITH {CLEAN_SQL}
        SELECT brand, quantile_disc(price, 0.5) AS median_price FROM C GROUP BY brand""",
    "outlier_filter": f"""WITH {CLEAN_SQL},
        M AS (SELECT brand, quantile_disc(price, 0.5) AS m FROM C GROUP BY brand)
        SELECT id, C.brand, title, price, url FROM C LEFT JOIN M ON C.brand = M.brand
        WHERE m IS NULL OR price < m * 10""",
    "outlier_events": """WITH M AS (
          SELECT event_type, quantile_disc(value, 0.5) AS m FROM events GROUP BY event_type)
        SELECT event_id, e.event_type, value FROM events e LEFT JOIN M ON e.event_type = M.event_type
        WHERE m IS NULL OR value < m * 10""",
    "insert_if_absent": f"""WITH {SNAPSHOT_SQL}
        SELECT id, brand, title, price, url, country FROM C
        WHERE url NOT IN (SELECT url FROM B) QUALIFY {FIRST}""",
    "fresh_not_cached": f"""WITH {SNAPSHOT_SQL}
        SELECT id, url, price FROM C WHERE url NOT IN (SELECT url FROM B)""",
    "stored_for_batch": f"""WITH {SNAPSHOT_SQL}
        SELECT id, url, price FROM B
        WHERE url IN (SELECT url FROM C WHERE scraped_at >= TIMESTAMP '{SNAPSHOT}')""",
    "cached_union_live": f"""WITH {SNAPSHOT_SQL}
        SELECT id, url, price, true AS cached FROM B
        UNION ALL
        SELECT * FROM (SELECT id, url, price, false AS cached FROM C
          WHERE url NOT IN (SELECT url FROM B) QUALIFY {FIRST})""",
    "arrays_to_json": f"""WITH {LISTINGS_SQL}
        SELECT id, url, price, concat('["', size, '"]') AS sizes, concat('["', color, '"]') AS colors FROM L""",
    "export_flat": f"""WITH {CLEAN_SQL}
        SELECT brand, title, price, currency, category, available, size AS sizes, color AS colors,
          country, url, image_url FROM C""",
    "available_snapshot": f"WITH {LISTINGS_SQL} SELECT id, url, price, title FROM L WHERE available",
    "with_defaults": """SELECT s_name AS domain, 2 AS subdomain_depth, '' AS country, 1 AS attempts
        FROM supplier""",
    "price_refresh": f"""WITH {SNAPSHOT_SQL},
        T AS (SELECT * FROM B UNION ALL SELECT * FROM C WHERE scraped_at >= TIMESTAMP '{SNAPSHOT}')
        SELECT id, url, price FROM T QUALIFY ROW_NUMBER() OVER (PARTITION BY url
          ORDER BY scraped_at DESC, id DESC, price DESC, brand DESC, title DESC) = 1""",
}
