from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomline.operators import candidates, outcomes, registry


def test_containment_equals_brute_force(spark):
    dice = random.Random(2)
    texts = ["https://" + "".join(dice.choices("ab.", k=dice.randint(1, 9))) for _ in range(60)]
    names = ["".join(dice.choices("ab.", k=dice.randint(1, 6))) for _ in range(80)]
    found = registry.contained_in(
        spark.createDataFrame([(n,) for n in names], "domain string"), "domain",
        spark.createDataFrame([(t,) for t in texts], "url string"), "url")
    assert {r.domain for r in found.collect()} == {n for n in names if any(n in t for t in texts)}


def test_missing_brands(spark):
    latest = spark.createDataFrame(
        [("shop.com", "pk", 1), ("new-shop.de", "DE", 1), ("blocked.com", "US", 0), ("1st.org", None, 1)],
        "domain string, country string, success int")
    known = spark.createDataFrame([("https://www.bigshop.com",)], "base_url string")
    rows = {r.base_url: r for r in registry.missing_brands(latest, known).collect()}
    assert set(rows) == {"https://new-shop.de", "https://1st.org"}
    assert (rows["https://new-shop.de"].name, rows["https://new-shop.de"].currency) == ("New Shop", "EUR")
    assert (rows["https://1st.org"].name, rows["https://1st.org"].primary_country) == ("1St", "US")


def test_outcomes_keep_first_country_and_latest_success(spark):
    log = spark.createDataFrame(
        [("a.uk", "GB", 0, 1), ("a.uk", "US", 1, 2), ("b.com", "US", 1, 3), ("b.com", "US", None, 4)],
        "domain string, country string, success int, ts long")
    rows = {r.domain: r for r in outcomes.latest_outcomes(log).collect()}
    assert (rows["a.uk"].country, rows["a.uk"].success, rows["a.uk"].attempts) == ("GB", 1, 2)
    assert rows["a.uk"].is_country_tld == 1 and rows["b.com"].is_com == 1


def test_learning_waits_for_rows_and_classes(spark):
    def latest(labels):
        frame = spark.createDataFrame(
            [(f"d{n}.com", "US", label) for n, label in enumerate(labels)],
            "domain string, country string, success int")
        return outcomes.with_features(frame)

    assert outcomes.train_outcome_model(latest([1, 0, 1, 0, None])) is None
    assert outcomes.train_outcome_model(latest([1] * 9)) is None
    model = outcomes.train_outcome_model(latest([1, 0] * 5))
    scored = outcomes.score_domains(model, latest([1, 0]).select("domain", "country"))
    assert all(0 <= r.probability <= 1 for r in scored.collect())


def test_budget_counts_only_what_passes(spark):
    found = spark.createDataFrame(
        [("US", f"d{n}.com", n) for n in range(8)], "country string, domain string, position int")
    latest = spark.createDataFrame([("d0.com", 0), ("d1.com", 1)], "domain string, success int")
    scored = spark.createDataFrame([("d2.com", 0.1), ("d3.com", 0.2)], "domain string, probability double")
    plan = candidates.plan_candidates(found, latest, 3, scored).orderBy("turn")
    assert [r.domain for r in plan.collect()] == ["d1.com", "d3.com", "d4.com"]


def test_domains_are_first_seen_and_plausible(spark):
    urls = spark.createDataFrame(
        [(1, "https://www.a.com/x"), (2, "http://a.com"), (3, "https://climbing.com"),
         (4, "https://localhost/x"), (5, "b.org"), (6, "https://c.org:8080/y")], "at int, url string")
    rows = candidates.domains_from_urls(urls, ["at"]).collect()
    assert {(r.at, r.base_url, r.domain) for r in rows} == {
        (1, "https://www.a.com", "a.com"), (6, "https://c.org:8080", "c.org:8080")}


def test_registration_is_by_address(spark):
    schema = """name string, base_url string, primary_country string, also_ships_to array<string>,
      currency string, platform string"""
    known = spark.createDataFrame([("A", "https://a.com", "US", ["CA"], "USD", "html")], schema)
    new = spark.createDataFrame(
        [("A2", "https://a.com", "gb", None, None, None), ("B", "https://b.com", "gb", None, None, None),
         ("C", "https://b.com", "gb", None, None, None)], schema)
    rows = {r.name: r for r in registry.register_new(known, new, ["name"]).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["B"].primary_country, rows["B"].currency, rows["B"].platform) == ("GB", "USD", "shopify")
    supported = spark.createDataFrame([("US",), ("CA",), ("FR",)], "country string")
    counts = registry.brands_per_country(known, supported).collect()
    assert {(r.country, r.brands) for r in counts} == {("US", 1), ("CA", 1), ("FR", 0)}


def test_plan_rotates_queries(spark):
    plan = candidates.discovery_plan(spark.createDataFrame([(0,), (16,)], "cycle int"))
    rows = {(r.cycle, r.country): r for r in plan.collect()}
    assert len(rows) == 20
    assert rows[(16, "GB")].phrase == "t-shirt clothing brand online shop United Kingdom"


def test_one_round_of_discovery(spark):
    """Plan, try, remember, register: what was tried is known the next time."""
    found = spark.createDataFrame(
        [("GB", f"https://d{n}.uk", f"d{n}.uk", n) for n in range(4)],
        "country string, base_url string, domain string, position int")
    log = spark.createDataFrame([("d0.uk", "GB", 0, 1)], "domain string, country string, success int, ts long")
    plan = candidates.plan_candidates(found, outcomes.latest_outcomes(log), 2)
    tried = plan.withColumn("success", (F.col("domain") == "d2.uk").cast("int"))
    assert {r.domain for r in tried.collect()} == {"d1.uk", "d2.uk"}
    brands = candidates.as_brands(tried).collect()
    assert [(r.name, r.base_url, r.currency) for r in brands] == [("D2", "https://d2.uk", "GBP")]
    later = log.unionByName(tried.select("domain", "country", "success", F.lit(2).cast("long").alias("ts")))
    again = candidates.plan_candidates(found, outcomes.latest_outcomes(later), 2)
    assert {r.domain for r in again.collect()} == {"d2.uk", "d3.uk"}
