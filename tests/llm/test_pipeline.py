"""The stages of the corpus pipeline against plain Python, on odd columns and repeated rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import mixing, oracles, ring
from tests.llm.conftest import prose
from tests.llm.test_pairs import (
    lower, plain_components, plain_contamination, plain_fingerprint,
)

ODD = ["a.b", "__text_hash", "_copy", "_hash", "kept_id", "bad_id", "toxic_result", "row", "size", "_in_1"]
BAD = "vile scum filth rotten".split()


def check_mixture(frame):
    """Taken words per source come within one document of its target, and as the SQL says."""
    rows = mixing.mix_report(frame)
    got = Counter(tuple(r) for r in rows.collect())
    connection = duckdb.connect()
    connection.register("documents", frame.select("doc_id", "source", "text").toPandas().astype(
        {"doc_id": "Int64"}))
    columns = ", ".join(rows.columns)
    want = connection.sql(f"SELECT {columns} FROM ({oracles.MIXTURE})").fetchall()
    rounded = lambda counted: Counter({(r[0], r[1], r[2], round(r[3], 6), r[4]): 0 for r in counted}) + Counter(
        [(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in counted for _ in range(counted[r])])
    assert rounded(got) == rounded(Counter(want))
    assert all(taken <= 3 * size for _, size, _, _, taken in got)
    sums, longest = Counter(), 0
    for (_, size, whole, target, taken), n in got.items():
        sums[whole, target] += taken * n
        longest = max(longest, size)
    assert all(abs(taken - target) <= longest for (_, target), taken in sums.items())


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(1, prose(1, 40), "a")] * 400 + [(i, prose(i, 5 + i % 40), "b") for i in range(2, 300)]
    rows += [(7, prose(7, 12), None)] * 90 + [(7, None, None)] * 3 + [(8, prose(8, 33), "c")] * 2
    check_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))


def test_rows_without_ids_have_draws_of_their_own(spark):
    rows = [(None, prose(i, 10 + i % 30), "ab"[i % 3 == 0]) for i in range(900)]
    rows += [(None, prose(4, 20), "a")] * 50 + [(i, prose(i, 25), "c") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_mixture(frame)
    named = frame.withColumns({"_hash": mixing.text_name(), "_copy": F.lit(0)}).where("doc_id IS NULL")
    draws = named.select("text", mixing.draw("s").alias("u")).distinct()
    assert draws.select("u").distinct().count() == draws.select("text").distinct().count()


def test_equal_rows_get_slots_of_their_own(spark):
    frame = spark.createDataFrame([(None, "same text")] * 500 + [(i, prose(i, 9)) for i in range(60)],
                                  "doc_id long, text string")
    placed = ring.shard_report(frame).collect()
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(slots) for slots in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 560


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic, copied, contaminated and plain documents, with columns under the operators' names."""
    item = prose(5000, 30)
    rows = []
    for i in range(400):
        text = prose(i, 60)
        if i % 4 == 1:
            words = text.split()
            text = " ".join(words[:20] + [BAD[i % 4], BAD[(i // 4) % 4], BAD[(i // 8) % 4]] * 2 + words[20:])
        elif i % 20 == 2:
            text = text + " " + item
        elif i % 20 == 3:
            text = prose(3, 60)
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
    rows += [(None, prose(901, 50), None, None, None), (None, None, None, None, None), (401, "", "en", "a", 0)]
    rows += [rows[0], rows[7]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({name: F.concat(F.lit(f"{at}-"), F.coalesce("source", F.lit("")))
                               for at, name in enumerate(ODD)})
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 == 1), 0) for i in range(400)],
                                   "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder


def key(row):
    return row["doc_id"] is None, row["doc_id"] or 0, row["text"] or ""


def plain_one_of_each(rows):
    prints = [plain_fingerprint(r["text"]) for r in rows]
    root = plain_components(prints)
    groups = defaultdict(list)
    for r, value in zip(rows, prints):
        groups[root[value]].append(r)
    return groups.values()


def test_stages_against_plain_python(spark, corpus):
    docs = corpus_pipeline.table(spark, corpus, "documents")
    steps = dict(corpus_pipeline.STAGES)
    before = docs.collect()

    rows = steps["toxicity"](spark, docs, corpus)
    assert rows.columns == docs.columns
    clean = rows.collect()
    assert Counter(clean) == Counter(r for r in before if not set(BAD) & set((r["text"] or "").split()))

    rows = steps["near_duplicates"](spark, corpus_pipeline.stage(rows, "t1"), corpus)
    assert rows.columns == docs.columns
    single = rows.collect()
    groups = list(plain_one_of_each(clean))
    assert len(single) == len(groups)
    for group in groups:
        held = [r for r in single if r in group]
        assert len(held) == 1 and key(held[0])[:2] == min(key(r)[:2] for r in group)

    rows = steps["decontamination"](spark, corpus_pipeline.stage(rows, "t2"), corpus)
    assert rows.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in
             corpus_pipeline.table(spark, corpus, "benchmark").collect()]
    bad = {r[0] for r in plain_contamination([(key(r), r["text"]) for r in single], items) if r[5]}
    fresh = rows.collect()
    assert bad and Counter(fresh) == Counter(r for r in single if key(r) not in bad)

    rows = steps["mixing"](spark, corpus_pipeline.stage(rows, "t3"), corpus)
    assert rows.columns == docs.columns
    copies, kept = Counter(rows.collect()), Counter(fresh)
    assert set(copies) <= set(kept) and all(n <= 3 * kept[r] for r, n in copies.items())
    words, taken = Counter(), Counter()
    for counted, out in ((kept, words), (copies, taken)):
        for r, n in counted.items():
            out[r["source"]] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(
        list(words.items()), "source string, source_size long")).collect()}
    longest = max(len(lower(r["text"]).split()) for r in fresh)
    assert all(abs(taken[s] - target) <= longest for s, target in targets.items())

    rows = steps["sharding"](spark, corpus_pipeline.stage(rows, "t4"), corpus)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r["doc_id"] for r in copies.elements())


def test_run_gives_what_its_stages_give(spark, corpus):
    first, second = (Counter(corpus_pipeline.run(spark, corpus).collect()) for _ in range(2))
    assert first == second and sum(first.values()) > 100
    assert not [r for r in first if r["doc_id"] is not None and r["doc_id"] % 4 == 1 and r["doc_id"] < 400]
