from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomline.operators import cleaning, dedup
from loomline.sources import tables, topic
from loomline.streaming import cleaner, live, outcomes
from loomline.plans import streams
from loomline.sources.deltas import append_delta
from tests.test_cleaning import listings

ONCE = {"availableNow": True}


def raw(spark):
    rows = [dict(url=f"u{n % 40}", price=float(n % 9), brand=f"b{n % 3}", title=f"t{n % 5}",
                 gender=["men", " F ", None][n % 3]) for n in range(120)]
    return listings(spark, rows + [dict(brand="b0", url="dear", price=1e6)] + rows[:30])


def send(frame, path, files):
    topic.encode(frame).repartition(files).write.text(path)


def run(spark, source, target, progress, **options):
    stream = topic.folder_stream(spark, source, files_per_batch=1)
    cleaner.start_cleaner(stream, target, progress, trigger=ONCE, **options).awaitTermination()
    return sorted((r.url, r.gender) for r in spark.read.parquet(target).collect())


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    """Whole rows, over 1, 3 and 12 batches; equal urls differ in their other columns."""
    rows = [dict(url=f"u{n % 40}", price=float(n % 9), brand=f"b{n % 3}", title=f"t{n % 5}",
                 gender=["men", " F ", None][n % 3], sizes=[f"s{n}"]) for n in range(120)]
    rows += [dict(brand="b0", url="dear", price=1e6)]
    numbered = [listings(spark, [row]).withColumn("n", F.lit(n)) for n, row in enumerate(rows)]
    frame = reduce(DataFrame.unionByName, numbered).repartition(4).persist()
    reference = cleaning.medians(cleaning.clean(frame.drop("n"))).persist()
    results = []
    for batches in (1, 3, 12):
        source, target = str(tmp_path / f"in-{batches}"), str(tmp_path / f"out-{batches}")
        per = -(-len(rows) // batches)
        records = topic.encode(frame, keep=["n"]).select(
            "value", F.lit(0).alias("partition"), F.col("n").cast("long").alias("offset"),
            F.timestamp_seconds("n").alias("timestamp"))
        for batch in range(batches):
            (records.where(F.floor(F.col("offset") / per) == batch).coalesce(1)
             .write.mode("append").parquet(source))
        cleaner.start_cleaner(
            topic.log_stream(spark, source, files_per_batch=1), target,
            str(tmp_path / f"progress-{batches}"), medians=lambda: reference, trigger=ONCE,
        ).awaitTermination()
        stored = spark.read.parquet(target).drop("scraped_at")
        results.append(sorted(map(repr, stored.select(sorted(stored.columns)).collect())))
    assert results[0] == results[1] == results[2] and results[0]
    first = {}
    for n, row in enumerate(rows):
        if row["price"] > 0 and row["url"] != "dear":
            first.setdefault(row["url"], n)
    assert len(results[0]) == len(first)
    for url, n in first.items():
        assert any(f"url='{url}'" in text and f"'s{n}'" in text for text in results[0])


def test_own_medians_equal_batch_however_it_is_cut(spark, tmp_path):
    """No table of medians is given: outliers of all rows are out, though early batches cannot know."""
    dice = random.Random(2)
    rows = [dict(url=f"u{dice.randint(0, 40)}", price=float(dice.choice([1, 2, 3, 4, 500, 9000 if n < 9 else 5])),
                 brand=f"b{n % 3}", title=f"t{n % 5}", sizes=[f"s{n}"]) for n in range(90)] * 2
    numbered = [listings(spark, [row]).withColumn("n", F.lit(n)) for n, row in enumerate(rows)]
    frame = reduce(DataFrame.unionByName, numbered).repartition(4).persist()
    kept = cleaning.outliers_removed(cleaning.clean(frame, order=["n"]))
    want = {(r.url, r.sizes[0], r.price) for r in dedup.first_wins(kept, ["url"], ["n"]).collect()}
    for batches in (1, 3, 12):
        source, folder = str(tmp_path / f"in-{batches}"), str(tmp_path / f"out-{batches}")
        records = topic.encode(frame, keep=["n"]).select(
            "value", F.lit(0).alias("partition"), F.col("n").cast("long").alias("offset"),
            F.timestamp_seconds("n").alias("timestamp"))
        for batch in range(batches):
            (records.where(F.floor(F.col("offset") * batches / len(rows)) == batch).coalesce(1)
             .write.mode("append").parquet(source))
        for progress in ("progress", "lost"):  # a replay from the start changes nothing
            cleaner.start_judging_cleaner(
                topic.log_stream(spark, source, files_per_batch=1), folder,
                str(tmp_path / f"{progress}-{batches}"), trigger=ONCE, compact_every=5, buckets=4,
            ).awaitTermination()
            got = cleaner.read_judged(spark, folder).collect()
            assert {(r.url, r.sizes[0], r.price) for r in got} == want and len(got) == len(want)


def test_insert_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "stored")
    tables.append_new(listings(spark, [dict(url=f"u{n}") for n in range(200)]), path, ["price"], buckets=32)
    stored = spark.read.parquet(path)
    batch = listings(spark, [dict(url="u7"), dict(url="new")]).withColumn("bucket", tables.key_bucket("url", 32))
    known = stored.where(F.col("bucket").isin(tables.touched(batch)))
    known.select("url").collect()
    plan = known.select("url")._jdf.queryExecution().executedPlan()
    assert known.select("bucket").distinct().count() <= 2 < stored.select("bucket").distinct().count()
    assert "PartitionFilters: [bucket" in plan.toString() and "ReadSchema: struct<url:string>" in plan.toString()
    tables.append_new(batch.drop("bucket"), path, ["price"], buckets=32)
    assert spark.read.parquet(path).count() == 201


def test_outcome_files_do_not_grow_with_epochs(spark, tmp_path):
    schema, state = "domain string, country string, success int, ts long", str(tmp_path / "state")
    opened = []
    for at in range(9):
        rows = spark.createDataFrame([("a.com", "US", at % 2, at), (f"d{at}.com", "GB", 1, at)], schema)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        outcomes.start_outcome_fold(stream, state, str(tmp_path / "progress"), ONCE, compact_every=3).awaitTermination()
        latest = outcomes.read_outcomes(spark, state)
        opened.append(len({f.rsplit("/", 2)[1] for f in latest.inputFiles()}))
        found = {r.domain: r for r in latest.collect()}
        assert len(found) == at + 2 and found["a.com"].attempts == at + 1 and found["a.com"].success == at % 2
    assert max(opened) <= 3


def test_rejected_rows_are_not_judged_again(spark, tmp_path):
    """Without a maintained table, a repeat of an outlier stays out of a later batch."""
    def batch(rows):
        topic.encode(listings(spark, rows)).coalesce(1).write.mode("append").text(str(tmp_path / "in"))

    batch([dict(url=f"u{n}", price=1.0, brand="b") for n in range(5)] + [dict(url="x", price=99.0, brand="b")])
    batch([dict(url="x", price=99.0, brand="b")])
    got = run(spark, *[str(tmp_path / name) for name in ("in", "out", "progress")])
    assert "x" not in {url for url, _ in got} and len(got) == 5


def test_callback_sees_every_batch(spark, tmp_path):
    send(raw(spark), str(tmp_path / "in"), 2)
    seen = []
    run(spark, *[str(tmp_path / name) for name in ("in", "out", "progress")],
        on_batch=lambda rows, epoch: seen.append((epoch, rows.count())))
    assert [epoch for epoch, _ in seen] == [0, 1]
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {"id", "scraped_at"} <= set(stored.columns)


def test_restart_adds_nothing(spark, tmp_path):
    send(raw(spark), str(tmp_path / "in"), 2)
    paths = [str(tmp_path / name) for name in ("in", "out", "progress")]
    first = run(spark, *paths)
    assert run(spark, *paths) == first
    # a lost checkpoint replays everything; stored urls are still unique
    assert run(spark, paths[0], paths[1], str(tmp_path / "progress-2")) == first


def test_outcome_fold_over_batches(spark, tmp_path):
    log = [("a.com", "US", 0, 1), ("b.com", "GB", 1, 2), ("a.com", "GB", 1, 3), ("a.com", "US", 0, 4)]
    frame = spark.createDataFrame(log, "domain string, country string, success int, ts long")
    for at in range(4):
        frame.where(f"ts = {at + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "log"))
        outcomes.start_outcome_fold(
            stream, str(tmp_path / "state"), str(tmp_path / "progress"), ONCE).awaitTermination()
    rows = {r.domain: r for r in outcomes.read_outcomes(spark, str(tmp_path / "state")).collect()}
    assert (rows["a.com"].country, rows["a.com"].success, rows["a.com"].attempts) == ("US", 0, 3)
    assert rows["b.com"].success == 1 and rows["b.com"].last_checked == 2


def test_fresh_stream_skips_stored_urls(spark, tmp_path):
    rows = listings(spark, [dict(url=f"u{n}") for n in range(6)])
    tables.append_new(rows.where("url < 'u3'"), str(tmp_path / "stored"), ["price"])
    send(rows, str(tmp_path / "in"), 1)
    live = topic.decode(topic.folder_stream(spark, str(tmp_path / "in")))
    query = (
        cleaner.fresh_stream(live, str(tmp_path / "stored")).select("url").writeStream
        .format("memory").queryName("fresh_urls").trigger(**ONCE).start()
    )
    query.awaitTermination()
    assert {r.url for r in spark.table("fresh_urls").collect()} == {"u3", "u4", "u5"}


def test_progress_of_a_live_run(spark, tmp_path):
    """Counts per brand over three batches, replayed from the start, with a compaction between."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "live")
    batches = [[("a", "u1"), ("a", "u2"), ("b", "u1"), (None, "u9")], [("b", "u3"), ("a", "u2")],
               [("a", "old"), ("b", "u4"), ("b", "u4")]]
    for rows in batches:
        frame = listings(spark, [dict(brand=brand, url=url, title=str(n)) for n, (brand, url) in enumerate(rows)])
        topic.encode(frame).coalesce(1).write.mode("append").text(source)
    cached = spark.createDataFrame([("old",)], "url string")
    for progress in ("first", "again"):
        live.start_live_run(topic.folder_stream(spark, source, files_per_batch=1), cached, folder,
                            str(tmp_path / progress), ONCE, compact_every=2, buckets=4).awaitTermination()
        counts = {r.brand: (r.found, r.new) for r in live.read_progress(spark, folder).collect()}
        assert counts == {"a": (4, 2), "b": (4, 2), None: (1, 1)}
        assert sorted(r.url for r in live.read_live(spark, folder).collect()) == ["u1", "u2", "u3", "u4", "u9"]


def test_a_batch_of_any_number_of_files_arrives_as_one(spark, tmp_path, monkeypatch):
    rows = listings(spark, [dict(url=f"u{n}") for n in range(30)]).withColumn(
        "id", F.substring("url", 2, 9).cast("long")).repartition(7)
    monkeypatch.setattr(streams, "listings", lambda spark, sf_dir: rows)
    seen = []

    def start(records):
        def note(batch, epoch):
            seen.append((epoch, sorted(row.offset for row in batch.collect())))

        return (records.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "progress"))
                .trigger(availableNow=True).start())

    streams.arrive(spark, "", start)
    assert seen == [(batch, [n for n in range(30) if n % 3 == batch]) for batch in range(3)]


def test_messages_are_packed_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "messages")
    monkeypatch.setattr(streams, "scratch_path", lambda spark, label: path)
    monkeypatch.setattr(streams, "PER_FILE", 10)
    streams.messages(spark, spark.range(95).select(F.col("id").cast("string").alias("value")), "x")
    assert len(list((tmp_path / "messages").glob("*.gz"))) >= 10
    assert spark.read.text(path).distinct().count() == 95


def test_a_delta_is_read_back_as_written(spark, tmp_path):
    changes = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("bucket"))
    written = append_delta(changes, str(tmp_path / "state"), 0, by="bucket")
    assert sorted(map(tuple, written.collect())) == [(n, n % 3) for n in range(20)]
    assert append_delta(changes.where("id < 0"), str(tmp_path / "state"), 1, by="bucket").isEmpty()


def test_dedup_remembers_hashes_of_keys(spark, tmp_path):
    """State holds two numbers a key, however long its texts; nulls are told apart by their column."""
    long = "x" * 500
    rows = [dict(url="u", brand=None, title="a"), dict(url="u", brand="a", title=None), dict(url="u", brand="", title="a"),
            dict(url=long, brand="b"), dict(url=long + "y", brand="b"), dict(url=None, brand=None, title=None, price=2.0)]
    send(listings(spark, rows * 3), str(tmp_path / "in"), 4)
    for mode in ("watermark", "forever"):
        progress, target = str(tmp_path / f"progress-{mode}"), str(tmp_path / f"out-{mode}")
        source = topic.decode(topic.folder_stream(spark, str(tmp_path / "in"), files_per_batch=2))
        distinct = cleaner.dedup_stream(source, mode=mode)
        assert distinct.columns == source.columns
        (distinct.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress)
         .trigger(**ONCE).start().awaitTermination())
        got = spark.read.schema(source.schema).parquet(target).select("url", "brand", "title").collect()
        want = listings(spark, rows).select("url", "brand", "title").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        remembered = spark.read.format("statestore").load(progress)
        assert remembered.count() == len(rows)
        assert [kind for _, kind in remembered.select("key.*").dtypes] == ["bigint", "int"]
