"""Rounds of discovery and pages found by their boundaries, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import ordinals, outcomes, rounds

BRAND = """name string, base_url string, primary_country string, also_ships_to array<string>,
  currency string, platform string"""


def start(spark, log=()):
    seen = spark.createDataFrame(list(log), "domain string, country string, success int, ts long")
    known = spark.createDataFrame([("Old", "https://d1.uk", "GB", ["US"], "GBP", "html")], BRAND)
    return rounds.Discovery(None, outcomes.latest_outcomes(seen), known)


def found(spark, names, countries=("GB",)):
    rows = [(c, f"https://{d}", d, n) for c in countries for n, d in enumerate(names)]
    return spark.createDataFrame(rows, "country string, base_url string, domain string, position int")


def answering(*working):
    def attempt(planned):
        return planned.withColumns({"success": F.col("domain").isin(*working).cast("int"),
                                    "platform": F.lit("html")})
    return attempt


def test_failures_are_skipped_and_brands_registered_once(spark):
    names = [f"d{n}.uk" for n in range(6)]
    searches = [found(spark, names)] * 3
    done = rounds.discover_and_learn(start(spark, [("d0.uk", "GB", 0, 1)]), searches,
                                     answering("d1.uk", "d3.uk"), 2, learn=False)
    tried = [(r["round"], r["domain"], r["success"], r["new_brand"])
             for r in done.attempts.orderBy("round", "turn").collect()]
    assert tried == [(1, "d1.uk", 1, False), (1, "d2.uk", 0, False), (2, "d1.uk", 1, False),
                     (2, "d3.uk", 1, True), (3, "d1.uk", 1, False), (3, "d3.uk", 1, False)]
    state = {r["domain"]: (r["success"], r["attempts"], r["last_checked"]) for r in done.latest.collect()}
    assert state == {"d0.uk": (0, 1, 1), "d1.uk": (1, 3, 3), "d2.uk": (0, 1, 1), "d3.uk": (1, 2, 3)}
    assert {(r["base_url"], r["name"], r["platform"]) for r in done.registry.collect()} == {
        ("https://d1.uk", "Old", "html"), ("https://d3.uk", "D3", "html")}


def test_a_site_of_several_countries_is_registered_for_the_first(spark):
    done = rounds.discover_and_learn(start(spark), [found(spark, ["new.com"], ("US", "FR", "GB"))],
                                     answering("new.com"), 5, learn=False)
    assert {(r["country"], r["new_brand"]) for r in done.attempts.collect()} == {
        ("US", False), ("FR", True), ("GB", False)}
    row = done.latest.where("domain = 'new.com'").first()
    assert (row["country"], row["attempts"]) == ("FR", 3)
    assert done.registry.where("base_url = 'https://new.com'").first()["primary_country"] == "FR"


def test_next_round_learns_from_the_last(spark):
    """Shops fail, others work: once a round has shown it, no further shop is tried."""
    shops, others = [f"shop{n}.com" for n in range(30)], [f"a{n}.other.com" for n in range(30)]
    mixed = [d for pair in zip(shops, others) for d in pair]
    searches = [found(spark, mixed[:20]), found(spark, mixed[20:40])]
    done = rounds.discover_and_learn(start(spark), searches, answering(*others), 20)
    tried = {(r["round"], r["domain"]): r["probability"] for r in done.attempts.collect()}
    assert {d for n, d in tried if n == 1} == set(mixed[:20])
    assert all(p is None for (n, _), p in tried.items() if n == 1)
    assert {d for n, d in tried if n == 2} == set(others[10:20])


def test_nothing_found_changes_nothing(spark):
    known = start(spark, [("d0.uk", "GB", 0, 1)])
    done = rounds.discover_and_learn(known, [found(spark, ["x.com"]).limit(0)], answering("x.com"), 5)
    assert done.attempts.isEmpty() and done.registry.count() == 1 and done.latest.count() == 1


@pytest.mark.parametrize("values,size", [(400, 7), (5, 10), (1, 48)])
def test_pages_by_boundaries(spark, values, size):
    """Ties that span pages, nulls, and every page against slices of the sorted rows."""
    dice = random.Random(values)
    rows = [(dice.choice([None, *range(values)]) if values > 1 else 3, dice.choice([None, "a", "b"]))
            for _ in range(205)]
    frame = spark.createDataFrame(rows, "k int, t string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    pages = ordinals.page_boundaries(frame, ["k", "t"], size).cache()
    starts = pages.orderBy("page").collect()
    assert [(r["page"], (r["k"], r["t"])) for r in starts] == [
        (n + 1, ordered[n * size]) for n in range(-(-len(rows) // size))]
    assert [r["skip"] for r in starts] == [
        r["page"] * size - size - ordered.index((r["k"], r["t"])) for r in starts]
    for number in (1, 2, len(starts) // 2 + 1, len(starts)):
        got = ordinals.seek_page(frame, ["k", "t"], pages, number, size).collect()
        assert [tuple(r) for r in got] == ordered[(number - 1) * size:number * size]
    assert ordinals.seek_page(frame, ["k", "t"], pages, len(starts) + 1, size).isEmpty()
    assert ordinals.page_boundaries(frame.limit(0), ["k", "t"], size).isEmpty()


def test_a_page_reads_its_range_only(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).repartitionByRange(8, "id").write.parquet(path)
    rows = spark.read.parquet(path)
    page = ordinals.seek_page(rows, ["id"], ordinals.page_boundaries(rows, ["id"], 50), 200, 50)
    assert [r["id"] for r in page.collect()] == list(range(9950, 10_000))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,9950)" in plan and "LessThanOrEqual(id,10000)" in plan
