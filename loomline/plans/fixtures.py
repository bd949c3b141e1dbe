"""Views over the given tables in the shapes the operators work on.

Every view comes twice: as a DataFrame and as the text of a common table
expression for the SQL check. Select lists that both engines accept are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.functions import web
from loomline.functions.text import ACCENTED, PLAIN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- listings: lineitem with its part, supplier and nation -------------------

LISTING_SELECT = [
    "l_orderkey * 10 + l_linenumber AS id",
    "p_brand AS brand",
    "p_name AS title",
    "CASE WHEN l_quantity >= 50 THEN l_extendedprice * 20 WHEN l_quantity <= 1 THEN 0e0"
    " ELSE l_extendedprice END AS price",
    "CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'"
    " WHEN 3 THEN 'PKR' ELSE 'CAD' END AS currency",
    "CASE WHEN l_discount >= 0.10 THEN '' ELSE concat('https://shop', CAST(l_suppkey AS STRING),"
    " '.example/products/', CAST(l_orderkey AS STRING)) END AS url",
    "CASE WHEN l_discount < 0.02 THEN NULL ELSE concat('https://img.example/',"
    " CAST(l_partkey AS STRING), '.jpg') END AS image_url",
    "CAST(p_size AS STRING) AS size",
    "split_part(p_name, ' ', 1) AS color",
    "split_part(p_name, ' ', 2) AS category",
    "l_linestatus = 'O' AS available",
    "n_name AS country",
    "CASE l_returnflag WHEN 'A' THEN ' Mens ' WHEN 'R' THEN 'LADIES' ELSE 'kids' END AS gender",
    "CASE WHEN l_tax >= 0.08 THEN '' ELSE p_type END AS description",
    "l_shipdate AS scraped_at",
]

LISTINGS_SQL = f"""L AS (
  SELECT {", ".join(LISTING_SELECT)}
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

GENDER_SQL = """CASE WHEN trim(lower(gender)) IN ('male', 'men', 'mens', 'm', 'man') THEN 'male'
  WHEN trim(lower(gender)) IN ('female', 'women', 'womens', 'f', 'woman', 'ladies') THEN 'female'
  ELSE 'unisex' END"""

CLEAN_SQL = f"""{LISTINGS_SQL}, C AS (
  SELECT * REPLACE ({GENDER_SQL} AS gender) FROM L
  WHERE url <> '' AND description <> '' AND price > 0)"""

FIRST_SEEN = ["scraped_at", "id", "price", "brand", "title"]
FIRST_SEEN_SQL = "scraped_at, id, price, brand, title"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings with planted defects; sizes and colors are arrays."""
    joined = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    flat = joined.selectExpr(*LISTING_SELECT)
    return flat.withColumns({"sizes": F.array("size"), "colors": F.array("color")}).drop(
        "size", "color"
    )


# ---- garments: part with clothing titles and addresses -----------------------

GARMENTS = [
    "Hooded Jacket", "Women's Tee", "Sweatshirt", "Slim Jeans", "Oxford", "Embroidered Kurta",
    "Printed Lawn Suit", "Silk Dupatta", "Chino Shorts", "Maxi Dress", "Knit Beanie",
    "Canvas Tote", "Leather Belt", "Boys Trainer", "Boxer Brief", "Wool Scarf", "Panty",
    "Mens Parka", "Crewneck", "Denim Skirt", "Salwar Kameez", "Saree", "Lamp", "What",
    "Graphic Tee Shirt",
]
PATHS = [
    "/collections/women/", "/shop/mens/", "/products/", "/girls-wear/", "//menswear/",
    "/for-him/", "/x-womens-y/", "/ladies/men/", "/p/", "/sale/her/",
]
GARMENT_TEXT = ", ".join("'" + name.replace("'", "''") + "'" for name in GARMENTS)
PATH_TEXT = ", ".join(f"'{path}'" for path in PATHS)

GARMENTS_SQL = f"""G AS (
  SELECT p_partkey, p_brand, p_size, p_type, p_retailprice,
    concat(p_name, ' ', ([{GARMENT_TEXT}])[CAST(p_size % {len(GARMENTS)} AS INTEGER) + 1]) AS title,
    concat('https://www.', lower(replace(p_brand, '#', '-')), '.example',
      ([{PATH_TEXT}])[CAST(floor(p_retailprice) % {len(PATHS)} AS INTEGER) + 1],
      CAST(p_partkey AS STRING)) AS url
  FROM part)"""


def garments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as garments, dealt to all tasks: a table of short rows lies in few splits."""
    names = F.array(*[F.lit(name) for name in GARMENTS])
    paths = F.array(*[F.lit(path) for path in PATHS])
    host = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    columns = ["p_partkey", "p_name", "p_brand", "p_size", "p_type", "p_retailprice"]
    return table(spark, sf_dir, "part").select(*columns).repartition("p_partkey", "p_name").select(
        "p_partkey", "p_brand", "p_size", "p_type", "p_retailprice",
        F.concat("p_name", F.lit(" "), F.get(names, F.col("p_size") % len(GARMENTS))).alias("title"),
        F.concat(
            F.lit("https://www."), host, F.lit(".example"),
            F.get(paths, (F.floor("p_retailprice") % len(PATHS)).cast("int")),
            F.col("p_partkey").cast("string"),
        ).alias("url"),
    )


# ---- registry: suppliers, shipping to later nations of their region ----------

REGISTRY_SQL = """R AS (
  SELECT s_name AS name, concat('https://shop', CAST(s_suppkey AS STRING), '.example') AS base_url,
    n.n_name AS primary_country, n.n_regionkey AS region, n.n_nationkey AS nation, s_suppkey,
    CASE n.n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
      WHEN 3 THEN 'PKR' ELSE 'CAD' END AS currency,
    CASE WHEN s_acctbal < 500 THEN 'html' ELSE 'shopify' END AS platform
  FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey),
S AS (
  SELECT R.name, R.base_url, R.primary_country AS country, R.currency, R.platform FROM R
  UNION ALL
  SELECT R.name, R.base_url, o.n_name, R.currency, R.platform
  FROM R JOIN nation o ON o.n_regionkey = R.region AND o.n_nationkey > R.nation)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    later = nation.select(
        F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("other"),
        F.col("n_name").alias("other_name"),
    )
    ships = (
        nation.join(later, (F.col("n_regionkey") == F.col("region"))
                    & (F.col("other") > F.col("n_nationkey")), "left")
        .groupBy("n_nationkey", "n_name", "n_regionkey")
        .agg(F.sort_array(F.collect_set("other_name")).alias("also_ships_to"))
    )
    money = F.expr(
        "CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'"
        " WHEN 3 THEN 'PKR' ELSE 'CAD' END"
    )
    return table(spark, sf_dir, "supplier").join(
        ships, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://shop"), F.col("s_suppkey").cast("string"),
                 F.lit(".example")).alias("base_url"),
        F.col("n_name").alias("primary_country"), "also_ships_to",
        money.alias("currency"),
        F.when(F.col("s_acctbal") < 500, "html").otherwise("shopify").alias("platform"),
    )


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supported countries."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))


# ---- outcomes: one attempt per page ------------------------------------------

AUTHORITY_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
SCHEME_SQL = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"

OUTCOMES_SQL = f"""O AS (
  SELECT page_id AS ts, replace({AUTHORITY_SQL}, 'www.', '') AS domain,
    upper(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)) AS country,
    CASE WHEN length(html) > 4000 THEN 1 ELSE 0 END AS success
  FROM pages),
LO AS (
  SELECT domain, arg_min(country, ts) AS country, arg_max(success, ts) AS success,
    count(*) AS attempts, max(ts) AS last_checked
  FROM O GROUP BY domain)"""


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ts"), web.domain_of(F.col("url")).alias("domain"),
        F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1)).alias("country"),
        (F.length("html") > 4000).cast("int").alias("success"),
    )


# ---- probes: suppliers that answered or not ------------------------------------

PROBES_SQL = """P AS (
  SELECT s_name AS name, n_name AS country, s_acctbal > 0 AS ok,
    CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 100) AS BIGINT) ELSE 0 END AS items_seen
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_name").alias("name"), F.col("n_name").alias("country"),
        (F.col("s_acctbal") > 0).alias("ok"),
        F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 100)).otherwise(0)
        .cast("bigint").alias("items_seen"),
    )


# ---- histories: what users said in conversations -------------------------------

def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return said.select(
        F.col("conv_id").alias("user_id"), F.col("turn").alias("ts"), F.col("text").alias("query")
    )


# ---- words as the full-text index sees them ------------------------------------

def folded_sql(text: str) -> str:
    return f"translate(lower({text}), '{ACCENTED}', '{PLAIN}')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({folded_sql(text)}, '[\\p{{L}}\\p{{N}}]+')"
