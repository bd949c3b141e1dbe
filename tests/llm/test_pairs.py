"""Near-duplicates, decontamination and weighted fingerprints against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomline.llm import components, decontam, simhash, weighted
from tests.llm.conftest import prose

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = SPACE_WORD.findall(lower(text))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(part.encode(), 42) for part in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Class labels of fingerprints linked at 3 bits or fewer, over all pairs."""
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_fingerprints_and_components(documents):
    got = simhash.duplicate_report(documents).collect()
    texts = documents.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], format(plain_fingerprint(r["text"]), "016x")) for r in texts)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == want
    roots = plain_components([int(r["fingerprint"], 16) for r in got])
    least = defaultdict(list)
    for r in got:
        if r["doc_id"] is not None:
            least[roots[int(r["fingerprint"], 16)]].append(r["doc_id"])
    for r in got:
        ids = least[roots[int(r["fingerprint"], 16)]]
        assert r["component_id"] == (min(ids) if ids else None)


def test_one_of_each(documents):
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(9) == 1 and 1 in ids and 2 not in ids and 3 not in ids and 5 not in ids


def test_links_survive_small_buckets(spark):
    """Dense clusters with buckets of two: longer keys must lose no link."""
    random = np.random.default_rng(3)
    values = set()
    for centre in random.integers(0, 2**63, 6, dtype=np.int64).tolist():
        for _ in range(40):
            flips = random.integers(0, 64, 2)
            values.add(int(np.int64(np.uint64(centre) ^ np.uint64(sum({1 << int(b) for b in flips})))))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    want = plain_components([v & (2**64 - 1) for v in values])
    for bucket in (2, 512):
        rows = components.components(simhash.links(frame, bucket)).collect()
        label = {r["node"]: r["root"] for r in rows}
        pairs = {(label.get(v, v), want[v & (2**64 - 1)]) for v in values}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7)], "a long, b long")
    rows = components.components(links).collect()
    assert {(r["node"], r["root"]) for r in rows} == {(i, 0) for i in range(41)}


def plain_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for item, text in items:
        w = word.findall(lower(text))
        size = min(13, len(w))
        windows += [(item, w[i:i + size]) for i in range(len(w) - size + 1) if w]
    out = []
    for doc, text in texts:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, 0 < len(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block", [None, 2000])
def test_contamination(spark, documents, monkeypatch, block):
    """In one block, and in several blocks of the benchmark."""
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    short = documents.where("length(text) < 5000 OR text IS NULL")
    texts = [(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()]
    sample = dict(texts)
    items = [(1, " ".join(sample[1].split()[20:60])), (2, " ".join(sample[110].split()[3:9])),
             (3, "one TWO"), (4, ""), (5, None), (6, "alpha0"), (1, "one two"), (None, sample[9]),
             (7, "not there at all " * 5), (8, sample[111]), (8, sample[111])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontamination_report(short, bench).collect()
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[f] for f in fields) for r in got) == plain_contamination(texts, items)
    kept = decontam.without_benchmark(short, bench)
    assert kept.columns == short.columns
    assert kept.count() == sum(not r["contaminated"] for r in got)


def test_empty_benchmark_and_documents(spark, documents, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.decontamination_report(documents, bench).where("contaminated").count()
    full = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontam.decontamination_report(nothing, full).count() == 0
    assert simhash.duplicate_report(nothing).count() == 0
    assert weighted.fingerprint_report(nothing).count() == 0


def test_weighted_fingerprints(documents):
    got = weighted.fingerprint_report(documents).collect()
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[3]["fingerprint"]
    assert by_id[4]["fingerprint"] == by_id[5]["fingerprint"] == weighted.EMPTY * 64
    assert by_id[4]["near_next"] == 1.0 and by_id[1]["near_next"] > 0.8
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    for doc, after in ((1, 2), (6, 7), (100, 101), (128, 129), (10, 11)):
        text, n = texts[doc], len(texts[doc])
        edited = text[:n - n // 4] + texts[after][:n // 4]
        assert by_id[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_id[doc]["n_chars"] == n


def test_collision_rate_is_generalised_jaccard(spark):
    """Over many weighted pairs the mean error of the likeness is near zero."""
    random = np.random.default_rng(5)
    rows, truth = [], {}
    for pair in range(150):
        weights = random.integers(0, 6, (2, 40))
        for side in (0, 1):
            rows += [(pair, 0, side, int(pair * 1000 + i), int(w))
                     for i, w in enumerate(weights[side]) if w]
        truth[pair] = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    frame = spark.createDataFrame(
        rows, "id_key long, text_hash long, side int, term long, weight int")
    samples = weighted.least_samples(frame).collect()
    sides = {(r["id_key"], r["side"]): [r[f"m{i}"] for i in range(64)]
             for r in samples}
    errors = []
    for pair, want in truth.items():
        both = [(a, b) for a, b in zip(sides[pair, 0], sides[pair, 1]) if a or b]
        errors.append(sum(a == b for a, b in both) / len(both) - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def likeness_of_weights(spark, pairs, total=None):
    """Shares of equal samples of pairs of weights (term -> weight), each over 64 samples."""
    rows = [(pair, 0, side, term, weight) for pair, sides in enumerate(pairs)
            for side, terms in enumerate(sides) for term, weight in terms.items()]
    frame = spark.createDataFrame(
        rows, "id_key long, text_hash long, side int, term long, weight int")
    if total:
        frame = frame.crossJoin(spark.createDataFrame([(total,)], "total int"))
    found = {(r["id_key"], r["side"]): [r[f"m{i}"] for i in range(64)]
             for r in weighted.least_samples(frame).collect()}
    assert all(value is not None for values in found.values() for value in values)
    return found, [np.mean([a == b for a, b in zip(found[i, 0], found[i, 1])])
                   for i in range(len(pairs))]


def test_samples_of_repeated_lines_and_short_texts(spark):
    """Heavy terms count by their weight, and few terms still give all samples."""
    heavy = []
    for n in range(20):
        line = {n * 10_000 + i: 1000 for i in range(10)}
        heavy.append([line | {n * 10_000 + 100 + 200 * side + i: 1 for i in range(200)}
                      for side in (0, 1)])
    found, rates = likeness_of_weights(spark, heavy)
    assert abs(np.mean(rates) - 10_000 / 10_400) < 0.02
    assert likeness_of_weights(spark, heavy, total=10_200)[0] == found  # what is left early is no sample
    short = [[{n * 10 + i: 1 for i in range(3)}, {n * 10 + i: 1 for i in (1, 2, 3)}]
             for n in range(100)]
    _, rates = likeness_of_weights(spark, short)
    assert abs(np.mean(rates) - 0.5) < 0.03 and np.std(rates) < 0.1


def test_likeness_of_texts_with_repeats_and_few_words(spark):
    """Own, edited and next texts against the generalised Jaccard of their shingles."""
    texts = ["the same line stands here again\n" * 300 + " ".join(f"a{i}" for i in range(150)),
             "the same line stands here again\n" * 300 + " ".join(f"b{i}" for i in range(150)),
             "one two three four five six seven", "one two three four five six eight", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in weighted.fingerprint_report(docs).collect()}

    def jaccard(one, two):
        one, two = [Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
                    for w in (one.split(), two.split())]
        return sum((one & two).values()) / sum((one | two).values())

    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        assert abs(got[i]["near_next"] - jaccard(text, after)) < 0.2
        assert abs(got[i]["near_edited"] - jaccard(text, edited)) < 0.2
    assert got[0]["near_next"] > 0.75


def test_open_samples_are_drawn_again(spark, documents, monkeypatch):
    """However little is kept at first, the fingerprints are those of all draws."""
    results = []
    for reach in (0.7, 60.0):
        monkeypatch.setattr(weighted, "REACH", reach)
        results.append(Counter(weighted.fingerprint_report(documents).collect()))
    assert results[0] == results[1]


def test_repeated_rows_do_not_multiply(spark):
    rows = [(1, prose(1, 80)), (2, prose(2, 80))] * 60 + [(3, prose(3, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    single = weighted.fingerprint_report(docs.distinct()).collect()
    got = Counter(weighted.fingerprint_report(docs).collect())
    assert got == Counter({row: 60 if row["doc_id"] < 3 else 1 for row in single})
    texts = weighted.edited_texts(docs, weighted.successors(docs))
    assert texts.count() == 3


def test_one_of_each_keeps_every_component(spark):
    """Null ids, one id with two texts, and copies: each component keeps exactly one row."""
    rows = [(None, prose(n, 60)) for n in range(500, 505)] + [(None, prose(500, 60))]
    rows += [(20, prose(510, 60)), (20, prose(511, 60)), (21, prose(511, 60)), (20, prose(511, 60))]
    rows += [(None, prose(512, 60)), (30, prose(512, 60)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"] or "") for r in simhash.one_of_each(docs).collect()]
    roots = plain_components([plain_fingerprint(text) for _, text in rows])
    best = {}
    for doc, text in rows:
        root = roots[plain_fingerprint(text)]
        best[root] = min(best.get(root, (True, 0)), (doc is None, doc or 0))
    got = Counter((roots[plain_fingerprint(text)], doc is None, doc or 0) for doc, text in kept)
    assert got == Counter((root, *least) for root, least in best.items())
    assert len(best) == 9
