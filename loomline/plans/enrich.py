"""Queries that derive fields of listings, sites and countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline import rules
from loomline.functions import web
from loomline.functions.listing import (
    absolute_url, categorize, in_stock, infer_gender, is_size, price_text,
)
from loomline.functions.text import parse_list
from loomline.operators import candidates, matching, registry as brands
from loomline.plans.fixtures import (
    AUTHORITY_SQL, GARMENTS_SQL, SCHEME_SQL, garments, outcome_log, table,
)

CODES = [*rules.COUNTRY_CODES, "KR", "zz"]
SIZE_ENDS = ["", "W", ".5", "/L", "xl", " cm", "L/", "W/32L"]
SIZE_WORDS = ["XS", "m", " large ", "One Size", "free size", "huge", "", "4XL"]
LINK_FORMS = ["/c/", "c/", "https://cdn.example/", "", "//x/", "HTTP://y/"]
STOCK_FORMS = [
    "https://schema.org/InStock", "https://schema.org/OutOfStock", "out of stock",
    "Out / Of / Stock", "", "PreOrder",
]
LIST_FORMS = ['["a", "b c"]', "a, b ,,c", '"one"', "17", "", "[]", '[1, 2.5]', "S|M", '{"k": "v"}']
LIST_READ = ["a|b c", "a|b|c", "one", "17", "", "", "1|2.5", "S|M", '{"k":"v"}']


def pick(forms: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(form) for form in forms]), (index % len(forms)).cast("int"))


def pick_sql(forms: list[str], index: str) -> str:
    quoted = ", ".join("'" + form.replace("'", "''") + "'" for form in forms)
    return f"([{quoted}])[CAST({index} % {len(forms)} AS INTEGER) + 1]"


def categories(spark, sf_dir):
    return garments(spark, sf_dir).select(
        "p_partkey", "title", categorize(F.col("title")).alias("category"),
        categorize(F.col("title"), mode="word").alias("word_category"),
    )


def genders(spark, sf_dir):
    rows = garments(spark, sf_dir).withColumn("category", categorize(F.col("title")))
    return rows.select(
        "p_partkey", "url",
        infer_gender(F.col("title"), F.col("url"), F.col("category")).alias("gender"),
    )


def document_categories(spark, sf_dir):
    """Whole texts as titles."""
    rows = table(spark, sf_dir, "documents").withColumn("category", categorize(F.col("text")))
    return rows.select(
        "doc_id", "category",
        infer_gender(F.col("text"), F.col("source"), F.col("category")).alias("gender"),
    )


def sizes(spark, sf_dir):
    number = F.concat(F.col("p_size").cast("string"), pick(SIZE_ENDS, F.col("p_partkey")))
    word = pick(SIZE_WORDS, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", is_size(number).alias("number_is_size"), is_size(word).alias("word_is_size")
    )


def prices(spark, sf_dir):
    digits = F.col("p_retailprice").cast("string")
    written = (
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit("1,"), digits))
        .when(F.col("p_type") == "SMALL", F.concat(F.col("p_size").cast("string"), F.lit(",50")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("$"), digits))
        .when(F.col("p_type") == "MEDIUM", F.lit(""))
        .otherwise(F.concat(F.lit(" "), digits, F.lit(" ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", price_text(written).alias("price"))


def addresses(spark, sf_dir):
    base = F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example/"))
    form = pick(LINK_FORMS, F.col("p_partkey"))
    link = F.when(form == "", form).otherwise(F.concat(form, F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", absolute_url(link, base).alias("url"))


def availability(spark, sf_dir):
    stock = pick(STOCK_FORMS, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", in_stock(stock).alias("available"))


def lists(spark, sf_dir):
    read = parse_list(pick(LIST_FORMS, F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(read, "|").alias("items"))


def coded_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", pick(CODES, F.col("c_custkey")).alias("country")
    )


def country_enrich(spark, sf_dir):
    code = F.col("country")
    return coded_customers(spark, sf_dir).select(
        "c_custkey", "country", brands.country_name(code).alias("name"),
        brands.country_currency(code).alias("currency"), web.country_tld(code).alias("tld"),
    )


def valid_country(spark, sf_dir):
    rows = coded_customers(spark, sf_dir).withColumn("country", F.lower("country"))
    return matching.valid_country(rows)


def domain_features(spark, sf_dir):
    log = outcome_log(spark, sf_dir)
    return log.select("ts", "domain", *[
        feature.alias(name)
        for name, feature in web.domain_features(F.col("domain"), F.col("country")).items()
    ])


def brand_from_domain(spark, sf_dir):
    """Page domains, and the same with digits and hyphens in front."""
    label = web.domain_of(F.col("url"))
    numbered = F.concat(F.col("page_id").cast("string"), F.lit("st-"), label)
    return table(spark, sf_dir, "pages").select(
        "page_id", web.brand_from_domain(label).alias("name"),
        web.brand_from_domain(numbered).alias("numbered_name"),
    )


def generic_filter(spark, sf_dir):
    """Pages whose domain, put under a shop's name, holds no marketplace's name."""
    shops = pick([*rules.GENERIC_SITES, "climbing", "loom", "atelier"], F.col("page_id"))
    named = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(shops, F.lit("."), web.domain_of(F.col("url"))).alias("domain")
    )
    return candidates.generic_dropped(named)


def base_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", web.base_url_of(F.col("url")).alias("base_url"),
        web.domain_of(F.col("url")).alias("domain"),
    )


QUERIES = {
    "categorize": categories,
    "infer_gender": genders,
    "categorize_documents": document_categories,
    "is_size": sizes,
    "price_text": prices,
    "absolute_url": addresses,
    "in_stock": availability,
    "parse_list": lists,
    "country_enrich": country_enrich,
    "valid_country": valid_country,
    "domain_features": domain_features,
    "brand_from_domain": brand_from_domain,
    "generic_filter": generic_filter,
    "base_urls": base_urls,
}


def category_sql(title: str, whole_words: bool = False) -> str:
    branches = []
    for category, keywords in rules.CATEGORY_KEYWORDS:
        if whole_words:
            pattern = "|".join(keyword.strip() for keyword in keywords)
            test = f"regexp_matches(lower({title}), '\\b({pattern})\\b')"
        else:
            test = " OR ".join(f"contains(lower({title}), '{keyword}')" for keyword in keywords)
        branches.append(f"WHEN {test} THEN '{category}'")
    return f"CASE {' '.join(branches)} ELSE 'other' END"


def gender_sql(title: str, url: str, category: str) -> str:
    def any_in(parts: list[str]) -> str:
        return " OR ".join(f"contains(lower({url}), '{part}')" for part in parts)

    dressed = ", ".join(f"'{name}'" for name in rules.FEMALE_CATEGORIES)
    return f"""CASE WHEN {any_in(rules.FEMALE_URL_HINTS)} THEN 'female'
      WHEN ({any_in(rules.MALE_URL_HINTS)}) AND NOT ({any_in(rules.MALE_URL_VETOES)}) THEN 'male'
      WHEN regexp_matches({title}, '(?i){rules.FEMALE_TITLE_PATTERN}') THEN 'female'
      WHEN regexp_matches({title}, '(?i){rules.MALE_TITLE_PATTERN}') THEN 'male'
      WHEN {category} IN ({dressed}) THEN 'female' ELSE 'unisex' END"""


SIZE_LIST = ", ".join(f"'{name}'" for name in rules.SIZE_NAMES)


def size_sql(value: str) -> str:
    shown = f"trim(upper({value}))"
    return f"""({shown} IN ({SIZE_LIST})
      OR regexp_matches(regexp_replace({shown}, '[WL./]', '', 'g'), '^[0-9]+$'))"""


def code_map_sql(values: dict[str, str], default: str) -> str:
    branches = " ".join(f"WHEN '{code}' THEN '{value}'" for code, value in values.items())
    return f"CASE upper(country) {branches} ELSE {default} END"


def title_sql(text: str) -> str:
    """Title case by runs of letters; page domains have ASCII and accented letters."""
    return f"""array_to_string(list_transform(
      regexp_extract_all(replace(string_split({text}, '.')[1], '-', ' '), '\\p{{L}}+|\\P{{L}}+'),
      lambda run: concat(upper(run[1]), lower(run[2:]))), '')"""


DOMAIN_SQL = f"replace({AUTHORITY_SQL}, 'www.', '')"
CUSTOMER_SQL = f"SELECT c_custkey, {pick_sql(CODES, 'c_custkey')} AS country FROM customer"
FORM_SQL = pick_sql(LINK_FORMS, "p_partkey")

ORACLE = {
    "categorize": f"""WITH {GARMENTS_SQL} SELECT p_partkey, title, {category_sql("title")} AS category,
        {category_sql("title", True)} AS word_category FROM G""",
    "infer_gender": f"""WITH {GARMENTS_SQL}, K AS (SELECT *, {category_sql("title")} AS category FROM G)
        SELECT p_partkey, url, {gender_sql("title", "url", "category")} AS gender FROM K""",
    "categorize_documents": f"""WITH K AS (
          SELECT *, {category_sql("text")} AS category FROM documents)
        SELECT doc_id, category, {gender_sql("text", "source", "category")} AS gender FROM K""",
    "is_size": f"""SELECT p_partkey,
        {size_sql(f"concat(CAST(p_size AS VARCHAR), {pick_sql(SIZE_ENDS, 'p_partkey')})")} AS number_is_size,
        {size_sql(pick_sql(SIZE_WORDS, "p_partkey"))} AS word_is_size FROM part""",
    "price_text": """SELECT p_partkey, CASE p_type
          WHEN 'LARGE' THEN TRY_CAST(concat('1', CAST(p_retailprice AS VARCHAR)) AS DOUBLE)
          WHEN 'SMALL' THEN p_size * 100e0 + 50 WHEN 'PROMO' THEN NULL WHEN 'MEDIUM' THEN NULL
          ELSE p_retailprice END AS price FROM part""",
    "absolute_url": f"""WITH T AS (SELECT p_partkey, concat('https://', lower(p_type), '.example') AS base,
          {FORM_SQL} AS form FROM part)
        SELECT p_partkey, CASE form WHEN '' THEN concat(base, '/')
          WHEN 'https://cdn.example/' THEN concat(form, CAST(p_partkey AS VARCHAR))
          ELSE concat(base, '/', ltrim(form, '/'), CAST(p_partkey AS VARCHAR)) END AS url FROM T""",
    "in_stock": f"""SELECT p_partkey, NOT contains(replace(replace(lower(
          {pick_sql(STOCK_FORMS, "p_partkey")}), ' ', ''), '/', ''), 'outofstock') AS available FROM part""",
    "parse_list": f"SELECT p_partkey, {pick_sql(LIST_READ, 'p_partkey')} AS items FROM part",
    "country_enrich": f"""WITH T AS ({CUSTOMER_SQL}) SELECT c_custkey, country,
        {code_map_sql({c: n for c, n, _ in rules.COUNTRIES}, "'Unknown'")} AS name,
        {code_map_sql({c: m for c, _, m in rules.COUNTRIES}, "'USD'")} AS currency,
        {code_map_sql(rules.COUNTRY_TLDS, "lower(country)")} AS tld FROM T""",
    "valid_country": f"""WITH T AS ({CUSTOMER_SQL}) SELECT c_custkey, upper(country) AS country FROM T
        WHERE upper(country) IN ({", ".join(f"'{code}'" for code in rules.COUNTRY_CODES)})""",
    "domain_features": f"""WITH T AS (SELECT page_id AS ts, {DOMAIN_SQL} AS domain,
          upper(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)) AS country FROM pages),
        E AS (SELECT *, regexp_extract(lower(domain), '[^.]*$') AS ending FROM T)
        SELECT ts, domain, CAST(length(domain) AS INTEGER) AS url_length,
          CAST(ending = 'com' AS INTEGER) AS is_com,
          CAST(ending = {code_map_sql(rules.COUNTRY_TLDS, "lower(country)")} AS INTEGER) AS is_country_tld,
          CAST(regexp_matches(lower(domain), 'shop|store|buy') AS INTEGER) AS has_shop,
          CAST(len(string_split(domain, '.')) AS INTEGER) AS subdomain_depth FROM E""",
    "brand_from_domain": f"""WITH T AS (SELECT page_id, {DOMAIN_SQL} AS domain FROM pages)
        SELECT page_id, {title_sql("domain")} AS name,
          {title_sql("concat(CAST(page_id AS VARCHAR), 'st-', domain)")} AS numbered_name FROM T""",
    "generic_filter": f"""WITH T AS (SELECT page_id, concat(
          {pick_sql([*rules.GENERIC_SITES, "climbing", "loom", "atelier"], "page_id")}, '.', {DOMAIN_SQL}) AS domain
          FROM pages)
        SELECT page_id, domain FROM T WHERE NOT regexp_matches(domain, '{"|".join(rules.GENERIC_SITES)}')""",
    "base_urls": f"""SELECT page_id, concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base_url,
        {DOMAIN_SQL} AS domain FROM pages""",
}
