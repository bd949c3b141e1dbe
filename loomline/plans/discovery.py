"""Queries of the brand registry, site outcomes and the discovery plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline import rules
from loomline.functions import web
from loomline.operators import candidates, dedup, outcomes, registry as brands, rounds
from loomline.plans.enrich import DOMAIN_SQL, title_sql
from loomline.plans.fixtures import (
    AUTHORITY_SQL, OUTCOMES_SQL, REGISTRY_SQL, SCHEME_SQL, histories, nations, outcome_log,
    registry, table,
)
from loomline.staging import stage

COUNTRY = "NATION_12"
PER_COUNTRY = 5
ROUNDS = 3
ANSWER_CHARS = 2000


def flat(rows):
    return rows.withColumn("also_ships_to", F.array_join("also_ships_to", ","))


def brands_for_country(spark, sf_dir):
    return brands.brands_for_country(registry(spark, sf_dir), COUNTRY.lower()).select(
        "name", "base_url", "primary_country")


def brand_names(spark, sf_dir):
    return brands.brand_names(registry(spark, sf_dir), COUNTRY)


def brand_country_expand(spark, sf_dir):
    return brands.brand_countries(registry(spark, sf_dir), nations(spark, sf_dir)).select(
        "name", "base_url", "country", "currency", "platform")


def brands_per_country(spark, sf_dir):
    """Brands of the whole registry by country served."""
    members = registry(spark, sf_dir)
    return brands.brands_per_country(members, nations(spark, sf_dir))


def incoming(spark, sf_dir):
    """Brands found on pages, and registered ones found again under a new name."""
    found = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("name"),
        web.base_url_of(F.col("url")).alias("base_url"), F.lit("us").alias("primary_country"),
        F.lit(None).cast("array<string>").alias("also_ships_to"),
        F.lit(None).cast("string").alias("currency"), F.lit("html").alias("platform"),
        F.col("page_id").alias("seen"),
    )
    again = registry(spark, sf_dir).withColumns(
        {"name": F.concat(F.lit("New "), F.col("name")), "seen": F.lit(-1).cast("bigint")})
    return found.unionByName(again)


def register_new(spark, sf_dir):
    return flat(brands.register_new(registry(spark, sf_dir), incoming(spark, sf_dir), ["seen"]))


def latest(spark, sf_dir):
    return outcomes.latest_outcomes(outcome_log(spark, sf_dir))


def outcome_latest(spark, sf_dir):
    return latest(spark, sf_dir).select(
        "domain", "country", "success", "attempts", "last_checked", *rules.FEATURES)


def outcome_status(spark, sf_dir):
    return outcomes.outcome_status(
        latest(spark, sf_dir), histories(spark, sf_dir), registry(spark, sf_dir))


def recent_outcomes(spark, sf_dir):
    return outcomes.recent_outcomes(latest(spark, sf_dir))


def judged(spark, sf_dir):
    """Documents as sites: success is the label, unlabelled ones are unknown."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.col("source"), F.lit("."), F.col("lang"), F.lit(".d"),
                 F.col("doc_id").cast("string")).alias("domain"),
        F.upper("lang").alias("country"), F.col("quality").alias("success"),
    )


def labelled_rows(spark, sf_dir):
    return outcomes.labelled(judged(spark, sf_dir))


def training_gate(spark, sf_dir):
    return outcomes.training_gate(judged(spark, sf_dir))


def missing_brands(spark, sf_dir):
    """Working domains against all registered addresses: those of the registry and of all pages.

    Some hosts are registered under a misspelt address only, so their domains are missing.
    """
    pages = table(spark, sf_dir, "pages")
    address = web.base_url_of(F.col("url"))
    misspelt = F.replace(address, F.lit("."), F.lit("-"))
    known = registry(spark, sf_dir).select("base_url").unionByName(pages.select(
        F.when(F.length(web.domain_of(F.col("url"))) % 2 == 0, misspelt).otherwise(address).alias("base_url")))
    return flat(brands.missing_brands(stage(latest(spark, sf_dir), "latest"), known))


def discover_domains(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return candidates.domains_from_urls(urls, ["page_id"]).select("page_id", "base_url", "domain")


def found(spark, sf_dir):
    """Candidates per country: the domains of its pages, in order of the pages."""
    urls = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"), "url",
        F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1)).alias("country"))
    return candidates.domains_from_urls(urls, ["position"], within=["country"])


def skip_blocked(spark, sf_dir):
    return candidates.blocked_skipped(found(spark, sf_dir), latest(spark, sf_dir)).select(
        "country", "domain", "base_url", "position")


def candidate_budget(spark, sf_dir):
    return candidates.plan_candidates(
        found(spark, sf_dir), latest(spark, sf_dir), PER_COUNTRY
    ).select("country", "domain", "base_url", "position", "turn")


def fallback_union(spark, sf_dir):
    """Secure addresses first; where a country has fewer than three, the others too."""
    urls = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"), "url",
        F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+/[0-9])", 1).alias("country"))
    named = urls.withColumn("domain", web.domain_of(F.col("url")))
    secure = named.where(F.col("url").startswith("https://")).drop("url")
    plain = named.where(F.col("url").startswith("http://")).drop("url")
    union = dedup.fallback_union(secure, plain, ["country"], "domain", ["position"])
    return union.select("country", "domain", "position", "fallback")


def discovery_plan(spark, sf_dir):
    cycles = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cycle")).distinct()
    return candidates.discovery_plan(cycles)


def split(spark, sf_dir):
    """Outcomes, told apart by digest into those to learn from and those to judge by."""
    rows = outcomes.labelled(latest(spark, sf_dir))
    return stage(rows.withColumn("held_out", outcomes.held_out(F.col("domain"))), "split")


def outcome_split(spark, sf_dir):
    """Sizes and feature sums of both parts."""
    sums = [F.sum(name).alias(name) for name in ("success", *rules.FEATURES)]
    return split(spark, sf_dir).groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), *sums)


def train_outcome(spark, sf_dir):
    """Confusion counts of a model of one part of the outcomes, on both."""
    rows = split(spark, sf_dir)
    model = outcomes.train_outcome_model(rows.where("NOT held_out"))
    scored = outcomes.score_domains(model, rows)
    predicted = (F.col("probability") >= 0.5).alias("predicted")
    return scored.groupBy("held_out", "success", predicted).agg(F.count(F.lit(1)).alias("n"))


def score_candidates(spark, sf_dir):
    rows = stage(latest(spark, sf_dir), "latest")
    model = outcomes.train_outcome_model(rows)
    scored = outcomes.score_domains(model, found(spark, sf_dir))
    return candidates.plan_candidates(found(spark, sf_dir), rows, PER_COUNTRY, scored).select(
        "country", "domain", "probability", "turn")


def discovered(spark, sf_dir, learn):
    """Pages dealt to a history and three rounds: what each round's searches find, and how it goes.

    A page is the answer of its site to an attempt of that round; a long one is a success.
    """
    pages = table(spark, sf_dir, "pages")
    dealt = F.pmod("page_id", F.lit(ROUNDS + 1))
    works = (F.length("html") > ANSWER_CHARS).cast("int")
    log = outcome_log(spark, sf_dir).drop("success").join(
        pages.where(dealt == 0).select(F.col("page_id").alias("ts"), works.alias("success")), "ts")
    known = rounds.Discovery(
        None, stage(outcomes.latest_outcomes(log), "latest"),
        stage(registry(spark, sf_dir), "registry"))
    urls = pages.select(
        dealt.alias("dealt"), F.col("page_id").alias("position"), "url",
        F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1)).alias("country"))
    found = [candidates.domains_from_urls(urls.where(F.col("dealt") == at), ["position"],
                                          within=["country"])
             .select("country", "domain", "base_url", "position") for at in range(1, ROUNDS + 1)]
    answers = pages.select(F.col("page_id").alias("position"), F.length("html").alias("chars"))

    def attempt(planned):
        seen = planned.join(answers, "position", "left")
        platform = F.when(F.col("chars") % 2 == 0, "shopify").otherwise("html")
        return seen.withColumns({"success": (F.col("chars") > ANSWER_CHARS).cast("int"), "platform": platform})

    return rounds.discover_and_learn(known, found, attempt, PER_COUNTRY, learn)


def discovery_rounds(spark, sf_dir):
    """All attempts of three rounds that learn only whom to skip and what is registered."""
    done = discovered(spark, sf_dir, learn=False)
    return done.attempts.drop("probability").join(
        done.latest.select("domain", F.col("attempts").alias("attempts_so_far"),
                           F.col("success").alias("last_success")), "domain")


def discovery_rounds_learned(spark, sf_dir):
    """The same with a model trained anew before every round."""
    return discovered(spark, sf_dir, learn=True).attempts


QUERIES = {
    f.__name__: f for f in (
        brands_for_country, brand_names, brand_country_expand, brands_per_country, register_new,
        outcome_latest, outcome_status, recent_outcomes, labelled_rows, training_gate,
        missing_brands, discover_domains, skip_blocked, candidate_budget, fallback_union,
        discovery_plan, outcome_split, train_outcome, score_candidates, discovery_rounds,
        discovery_rounds_learned,
    )
}

FEATURES_SQL = """CAST(length(domain) AS INTEGER) AS url_length,
  CAST(regexp_extract(lower(domain), '[^.]*$') = 'com' AS INTEGER) AS is_com,
  CAST(regexp_extract(lower(domain), '[^.]*$') = CASE upper(country) WHEN 'GB' THEN 'uk'
    WHEN 'US' THEN 'com' ELSE lower(country) END AS INTEGER) AS is_country_tld,
  CAST(regexp_matches(lower(domain), 'shop|store|buy') AS INTEGER) AS has_shop,
  CAST(len(string_split(domain, '.')) AS INTEGER) AS subdomain_depth"""

SHIPS_SQL = """SH AS (SELECT R.name, R.base_url, R.primary_country, R.currency, R.platform,
    coalesce(string_agg(o.n_name, ',' ORDER BY o.n_name), '') AS also_ships_to
  FROM R LEFT JOIN nation o ON o.n_regionkey = R.region AND o.n_nationkey > R.nation
  GROUP BY ALL)"""

GENERIC = "|".join(rules.GENERIC_SITES)
FOUND_SQL = f"""{OUTCOMES_SQL}, F AS (
  SELECT page_id AS position, upper(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)) AS country,
    {DOMAIN_SQL} AS domain, concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base_url FROM pages
  WHERE contains({DOMAIN_SQL}, '.') AND NOT regexp_matches({DOMAIN_SQL}, '{GENERIC}')
  QUALIFY ROW_NUMBER() OVER (PARTITION BY country, domain ORDER BY page_id) = 1),
K AS (SELECT * FROM F WHERE domain NOT IN (SELECT domain FROM LO WHERE success = 0))"""

JUDGED_SQL = """J AS (SELECT concat(source, '.', lang, '.d', CAST(d.doc_id AS VARCHAR)) AS domain,
    upper(lang) AS country, quality AS success FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

WHEEL = ", ".join(f"'{query}'" for query in rules.DISCOVERY_QUERIES)
COUNTRY_VALUES = ", ".join(f"('{code}', '{name}')" for code, name, _ in rules.COUNTRIES)



def round_sql(at):
    """One round: found, tried, newly registered, and the state after it."""
    return f"""F{at} AS (
  SELECT * FROM A WHERE dealt = {at}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY country, domain ORDER BY position) = 1),
P{at} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY position, domain) AS turn FROM F{at}
  WHERE domain NOT IN (SELECT domain FROM S{at - 1} WHERE success = 0) QUALIFY turn <= {PER_COUNTRY}),
G{at} AS (SELECT base_url, min(country) AS country FROM P{at} WHERE success = 1
    AND base_url NOT IN (SELECT base_url FROM K{at - 1}) GROUP BY base_url),
K{at} AS (SELECT base_url FROM K{at - 1} UNION ALL SELECT base_url FROM G{at}),
S{at} AS (
  SELECT domain, last(success ORDER BY age, country) AS success, sum(attempts) AS attempts
  FROM (SELECT domain, '' AS country, success, attempts, 0 AS age FROM S{at - 1}
    UNION ALL SELECT domain, country, success, 1, 1 FROM P{at}) GROUP BY domain),
T{at} AS (SELECT {at} AS round, P.*, G.country IS NOT NULL AND P.success = 1 AS new_brand
  FROM P{at} P LEFT JOIN G{at} G ON P.base_url = G.base_url AND P.country = G.country)"""


ROUNDS_SQL = f"""A AS (
  SELECT page_id % {ROUNDS + 1} AS dealt, page_id AS position, {DOMAIN_SQL} AS domain,
    upper(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)) AS country,
    concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base_url,
    CAST(length(html) > {ANSWER_CHARS} AS INTEGER) AS success,
    CASE WHEN length(html) % 2 = 0 THEN 'shopify' ELSE 'html' END AS platform
  FROM pages WHERE contains({DOMAIN_SQL}, '.') AND NOT regexp_matches({DOMAIN_SQL}, '{GENERIC}')),
S0 AS (SELECT domain, arg_max(success, position) AS success, count(*) AS attempts FROM A
  WHERE dealt = 0 GROUP BY domain),
K0 AS (SELECT base_url FROM R),
{", ".join(round_sql(at) for at in range(1, ROUNDS + 1))},
T AS ({" UNION ALL ".join(f"SELECT * FROM T{at}" for at in range(1, ROUNDS + 1))})"""

ORACLE = {
    "outcome_split": f"""WITH {OUTCOMES_SQL}, X AS (SELECT success, {FEATURES_SQL},
          CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) % 5 = 0 AS held_out FROM LO)
        SELECT held_out, count(*) AS n, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}"
                                                   for c in ("success", *rules.FEATURES))}
        FROM X GROUP BY held_out""",
    "discovery_rounds": f"""WITH {REGISTRY_SQL}, {OUTCOMES_SQL}, {ROUNDS_SQL}
        SELECT round, country, T.domain, base_url, turn, T.success, platform, new_brand,
          CAST(S{ROUNDS}.attempts AS BIGINT) AS attempts_so_far, S{ROUNDS}.success AS last_success
        FROM T JOIN S{ROUNDS} ON T.domain = S{ROUNDS}.domain""",
    "brands_for_country": f"""WITH {REGISTRY_SQL} SELECT name, base_url, primary_country FROM R
        WHERE name IN (SELECT name FROM S WHERE country = '{COUNTRY}')""",
    "brand_names": f"WITH {REGISTRY_SQL} SELECT name FROM S WHERE country = '{COUNTRY}'",
    "brand_country_expand": f"""WITH {REGISTRY_SQL}
        SELECT name, base_url, country, currency, platform FROM S""",
    "brands_per_country": f"""WITH {REGISTRY_SQL} SELECT n_name AS country, count(name) AS brands
        FROM nation LEFT JOIN S ON country = n_name GROUP BY n_name""",
    "register_new": f"""WITH {REGISTRY_SQL}, {SHIPS_SQL}, I AS (
          SELECT concat('Page ', CAST(page_id AS VARCHAR)) AS name,
            concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base_url FROM pages
          QUALIFY ROW_NUMBER() OVER (PARTITION BY base_url ORDER BY page_id) = 1)
        SELECT name, base_url, primary_country, also_ships_to, currency, platform FROM SH
        UNION ALL SELECT name, base_url, 'US', '', 'USD', 'html' FROM I""",
    "outcome_latest": f"""WITH {OUTCOMES_SQL} SELECT domain, country, success, attempts, last_checked,
        {FEATURES_SQL} FROM LO""",
    "outcome_status": f"""WITH {OUTCOMES_SQL} SELECT count(*) AS total_domains,
        count(*) FILTER (success = 1) AS successful, count(*) FILTER (success = 0) AS blocked,
        (SELECT count(*) FROM conversations WHERE role = 'user') AS search_runs,
        (SELECT count(*) FROM supplier) AS total_brands FROM LO""",
    "recent_outcomes": f"""WITH {OUTCOMES_SQL} SELECT domain, country,
        CASE success WHEN 1 THEN 'success' ELSE 'blocked' END AS status, attempts, last_checked FROM LO""",
    "labelled_rows": f"WITH {JUDGED_SQL} SELECT * FROM J WHERE success IS NOT NULL",
    "training_gate": f"""WITH {JUDGED_SQL} SELECT count(*) AS labelled_rows,
        count(DISTINCT success) AS classes, count(*) >= 6 AND count(DISTINCT success) >= 2 AS ready
        FROM J WHERE success IS NOT NULL""",
    "missing_brands": f"""WITH {REGISTRY_SQL}, {OUTCOMES_SQL}, K AS (
          SELECT base_url FROM R
          UNION SELECT CASE WHEN letters % 2 = 0 THEN replace(base, '.', '-') ELSE base END
          FROM (SELECT length({DOMAIN_SQL}) AS letters, concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base FROM pages))
        SELECT {title_sql("domain")} AS name, concat('https://', domain) AS base_url,
          upper(country) AS primary_country, '' AS also_ships_to,
          CASE upper(country) WHEN 'DE' THEN 'EUR' WHEN 'FR' THEN 'EUR' ELSE 'USD' END AS currency,
          'shopify' AS platform
        FROM LO WHERE success = 1
          AND NOT EXISTS (SELECT 1 FROM K WHERE contains(K.base_url, LO.domain))""",
    "discover_domains": f"""SELECT page_id, concat({SCHEME_SQL}, '://', {AUTHORITY_SQL}) AS base_url,
          {DOMAIN_SQL} AS domain FROM pages
        WHERE contains({DOMAIN_SQL}, '.') AND NOT regexp_matches({DOMAIN_SQL}, '{GENERIC}')
        QUALIFY ROW_NUMBER() OVER (PARTITION BY {DOMAIN_SQL} ORDER BY page_id) = 1""",
    "skip_blocked": f"WITH {FOUND_SQL} SELECT country, domain, base_url, position FROM K",
    "candidate_budget": f"""WITH {FOUND_SQL}
        SELECT country, domain, base_url, position,
          ROW_NUMBER() OVER (PARTITION BY country ORDER BY position, domain) AS turn FROM K
        QUALIFY turn <= {PER_COUNTRY}""",
    "fallback_union": f"""WITH T AS (
          SELECT page_id AS position, {DOMAIN_SQL} AS domain, url LIKE 'https://%' AS secure,
            regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+/[0-9])', 1) AS country FROM pages),
        D AS (SELECT country, domain, secure, min(position) AS position FROM T GROUP BY ALL),
        E AS (SELECT country FROM D WHERE secure GROUP BY country HAVING count(*) >= 3)
        SELECT country, domain, position, NOT secure AS fallback FROM D
        WHERE secure OR (country NOT IN (SELECT country FROM E) AND (country, domain) NOT IN (
          SELECT country, domain FROM D WHERE secure))""",
    "discovery_plan": f"""WITH C AS (SELECT DISTINCT conv_id AS cycle FROM conversations),
        V(country, name) AS (VALUES {COUNTRY_VALUES}),
        P AS (SELECT cycle, ([{WHEEL}])[CAST(cycle % {len(rules.DISCOVERY_QUERIES)} AS INTEGER) + 1] AS query,
          country, name FROM C CROSS JOIN V)
        SELECT cycle, query, country,
          concat(query, ' clothing brand online shop ', name) AS phrase FROM P""",
}
