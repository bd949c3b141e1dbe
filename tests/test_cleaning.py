from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomline.operators import cleaning, dedup, ordinals
from loomline.schemas import RAW_LISTING
from loomline.sources import tables


def listings(spark, rows):
    """Listings with defaults for what a test does not care about."""
    base = dict(brand="b", title="t", price=10.0, currency="USD", url="u", image_url="i",
                sizes=["M"], colors=["red"], category="c", available=True, country="US",
                gender="men", description="d")
    return spark.createDataFrame([{**base, **row} for row in rows], RAW_LISTING)


def test_unusable_rows_are_dropped(spark):
    rows = listings(spark, [
        dict(url=None), dict(url=""), dict(description=None), dict(description=""),
        dict(price=0.0), dict(price=None), dict(price=-1.0), dict(price=float("nan")), dict(url="ok"),
    ])
    kept = cleaning.usable(rows).select("url", "price").collect()
    assert sorted(row.url for row in kept) == ["ok", "u"]


def test_duplicates_are_judged_before_genders_are_unified(spark):
    rows = listings(spark, [dict(gender="men"), dict(gender="MEN"), dict(gender="men", sizes=["L"])])
    cleaned = cleaning.clean(rows).collect()
    assert len(cleaned) == 2
    assert {row.gender for row in cleaned} == {"male"}


def test_clean_is_idempotent(spark):
    rows = listings(spark, [dict(url=f"u{n % 7}", price=float(n % 5)) for n in range(50)])
    once = cleaning.clean(rows)
    twice = cleaning.clean(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_outliers_null_brand_and_exact_bound(spark):
    prices = [1.0, 2.0, 3.0, 20.0, 19.99]
    rows = listings(spark, [dict(brand="x", price=p, url=f"x{p}") for p in prices]
                    + [dict(brand=None, price=1e9, url="none"), dict(brand=None, price=1.0, url="n1")])
    assert cleaning.medians(rows).where("brand = 'x'").first().median_price == 3.0
    reference = spark.createDataFrame([("x", 2.0)], "brand string, median_price double")
    kept = cleaning.outliers_removed(rows, reference=reference)
    assert {row.url for row in kept.collect()} == {"x1.0", "x2.0", "x3.0", "x19.99", "none", "n1"}


def test_minimal_rules(spark):
    row = cleaning.clean_minimal(listings(spark, [
        dict(description=None, image_url=None, category="", sizes=None, available=None, gender="\tF"),
    ])).first()
    assert (row.image_url, row.category, row.sizes, row.available, row.gender) == (
        "", "other", [], False, "female")


def test_append_is_first_wins_and_replay_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "stored")
    first = listings(spark, [dict(url="a", price=2.0), dict(url="a", price=1.0), dict(url="b")])
    tables.append_new(first, path, ["price"])
    tables.append_new(first, path, ["price"])
    tables.append_new(listings(spark, [dict(url="a", price=0.5), dict(url="c")]), path, ["price"])
    stored = {row.url: row.price for row in spark.read.parquet(path).collect()}
    assert stored == {"a": 1.0, "b": 10.0, "c": 10.0}
    assert spark.read.parquet(path).count() == 3


def test_latest_mode_refreshes(spark):
    old = listings(spark, [dict(url="a", price=1.0)])
    new = listings(spark, [dict(url="a", price=3.0), dict(url="b", price=2.0)])
    rows = tables.upsert_latest(new, old, ["price"]).collect()
    assert {row.url: row.price for row in rows} == {"a": 3.0, "b": 2.0}


def test_cached_rows_win_and_live_rows_follow(spark):
    cached = listings(spark, [dict(url="a", price=1.0)])
    live = listings(spark, [dict(url="a", price=9.0), dict(url="b", price=8.0), dict(url="b", price=7.0)])
    rows = dedup.cached_then_live(cached, live, ["price"]).collect()
    assert {(r.url, r.price, r.cached) for r in rows} == {("a", 1.0, True), ("b", 7.0, False)}


def test_fallback_only_where_primary_found_too_few(spark):
    def rows(*pairs):
        return spark.createDataFrame(
            [(g, d, at) for at, (g, d) in enumerate(pairs)], "g string, domain string, at int")

    primary = rows(("x", "a"), ("x", "b"), ("x", "c"), ("y", "a"), ("y", "a"))
    secondary = rows(("x", "d"), ("y", "a"), ("y", "e"), ("z", "f"))
    union = dedup.fallback_union(primary, secondary, ["g"], "domain", ["at"]).collect()
    assert {(r.g, r.domain, r.fallback) for r in union} == {
        ("x", "a", False), ("x", "b", False), ("x", "c", False), ("y", "a", False),
        ("y", "e", True), ("z", "f", True)}


def test_ranks_beyond_the_group_limit(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 3 == 0).alias("part"), F.xxhash64("id").alias("score"), "id")
    order = [F.col("score")]
    few = dedup.topk_per(rows, ["part"], order, 1500)
    ranked = rows.toPandas().sort_values(["part", "score"])
    want = set(ranked.groupby("part").head(1500).id)
    assert {row.id for row in few.collect()} == want


def test_positions_with_a_hot_group(spark):
    dice = random.Random(1)
    rows = [("hot" if n % 3 else f"g{n % 11}", dice.randint(0, 50), n) for n in range(900)]
    frame = spark.createDataFrame(rows, "g string, v int, n int").repartition(7)
    numbered = ordinals.number_rows(frame, [F.col("v"), F.col("n")], by=["g"])
    got = {(r.g, r.n): r.position for r in numbered.collect()}
    want = {}
    for group in {row[0] for row in rows}:
        inside = sorted((row for row in rows if row[0] == group), key=lambda row: row[1:])
        want.update({(group, row[2]): at for at, row in enumerate(inside, 1)})
    assert got == want
    overall = ordinals.number_rows(frame, [F.desc("v"), F.asc("n")])
    ranked = sorted(rows, key=lambda row: (-row[1], row[2]))
    assert {r.n: r.position for r in overall.collect()} == {
        row[2]: at for at, row in enumerate(ranked, 1)}


def test_pages(spark):
    assert ordinals.page_count(spark.range(0)).first().pages == 1
    assert ordinals.page_count(spark.range(49)).first().pages == 2
    shown = ordinals.page(spark.range(100), [F.col("id")], 3).collect()
    assert [row.id for row in shown] == [96, 97, 98, 99]


def test_exports(spark, tmp_path):
    rows = listings(spark, [dict(sizes=["S", "M"], title='a "b", c')])
    assert tables.write_csv(rows.limit(0), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()
    assert tables.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.title, back.sizes, len(back)) == ('a "b", c', "S|M", 11)
    tables.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().sizes == ["S", "M"]
    tables.log_search(spark, str(tmp_path / "log"), "US", "hoodie")
    tables.log_search(spark, str(tmp_path / "log"), "US", "dress")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_first_rows_carry_only_what_is_shown(spark):
    """Columns compared after the last one shown are not shuffled; the shown ones stay the same."""
    rows = spark.createDataFrame(
        [(n % 3, n % 2, "ab"[n % 2], str(n), None if n % 4 else "x") for n in range(24)],
        "k int, at int, a string, b string, c string")
    whole = dedup.first_wins(rows, ["k"], ["at"])
    for shown in (["k"], ["k", "a"], ["a", "c"], ["k", "at"], ["b"]):
        part = dedup.first_wins(rows, ["k"], ["at"], shown)
        assert part.columns == [name for name in rows.columns if name in shown]
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(*part.columns).collect()))
    plan = dedup.first_wins(rows, ["k"], ["at"], ["k", "a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(at" in plan and "b, b" not in plan and "c, c" not in plan
