"""Fill-in-middle, exact duplicates and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import dom, grace, middle, negatives
from tests.llm.conftest import prose

MIDDLE = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:one], units[one:two], units[two:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(output), sha(text)


@pytest.fixture(scope="module")
def texts(spark):
    tricky = ["a<P>b", "<S>", "x<M>", "<P", "<", "<S<S", "\n\n", "abc", "é", "漢字abc漢字", "😀😀 a1b2", "Áb",
              "a" * 5000, "é" * 3000, "ab " * 2000 + "ü", "x\ty\r\nz", "[Z`@{", " lead and trail ", "\x00a\x00"]
    return spark.createDataFrame(
        [(1000 + 17 * i + j, t) for i, t in enumerate(tricky) for j in range(12)], "doc_id long, text string")


def test_middle(documents, nothing, texts):
    for frame in (documents, texts):
        got = Counter(tuple(r[c] for c in MIDDLE) for r in middle.middle_report(frame).collect())
        assert got == Counter(plain_middle(r["doc_id"], r["text"]) for r in frame.collect())
    assert middle.middle_report(nothing).count() == 0
    forms = Counter(r["form"] for r in middle.middle_report(texts).collect())
    assert set(forms) == {"plain", "psm", "spm"}


def test_middle_keeps_other_columns(spark, documents):
    rows = spark.createDataFrame([(1, "some text here", "x", "y", 3)],
                                 "doc_id long, text string, `cut` string, `a.b` string, n long")
    out = middle.middle_corpus(rows)
    assert out.columns == rows.columns
    want = {(r["doc_id"], r["output"]) for r in middle.fill_in_middle(rows).collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == want
    assert out.first()["cut"] == "x" and out.first()["a.b"] == "y"
    assert middle.middle_corpus(documents).columns == documents.columns
    other = middle.fill_in_middle(documents, seed="2").select("doc_id", "form").collect()
    assert Counter(other) != Counter(middle.fill_in_middle(documents).select("doc_id", "form").collect())


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_descent_equals_counting(block):
    for text in ("", "a", "ab cd", "a" * 40 + "é漢 b" * 9, prose(3, 60)):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        units = middle.Units(data, block)
        pieces = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert units.n == len(pieces) and units.chars == len(text)
        for u in range(len(pieces) + 1):
            assert units.chars_before(u) == len("".join(pieces[:u]))


def plain_groups(rows):
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or "", at))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for doc_id, text, _ in members:
            out.append((doc_id, keep[0], len(members), sha(bare)))
    return Counter(out), len(groups)


def check_groups(frame, **limits):
    rows = grace.exact_groups(frame, **limits).collect()
    want, n = plain_groups([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == n == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates(spark, documents, nothing):
    check_groups(documents)
    assert grace.exact_groups(nothing).count() == 0
    extra = [(i, t) for i, t in enumerate(
        ["a b", "ab", " a b ", "a b", "A B", "a\x0b\x0cb", "", " ", None, "x", "x", "é", "é"])]
    check_groups(spark.createDataFrame([(50 - i, t) for i, t in extra] + [(50, "x")] * 2, "doc_id long, text string"))


def test_crowded_buckets_are_dealt_again(spark):
    """Small limits: several levels, a content copied into every table, texts above the limit."""
    rows = [(i, prose(i % 40, 30 + i % 40)) for i in range(300)]
    rows += [(1000 + i, "same text " * 30) for i in range(500)] + [(2000 + i, prose(7, 900)) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check_groups(frame, limit=1500, aim=700, table_bytes=2000, table_rows=20)
    check_groups(frame, limit=1, aim=1, table_bytes=1, table_rows=1)


def test_table_compares_whole_contents():
    table = grace.ContentTable(room=2)
    entries = [table.place(5, b"%d" % (i % 50)) for i in range(200)]
    assert entries == [i % 50 for i in range(200)]
    assert table.place(6, b"1") == 50 and table.place(-5, b"1") == 51


def test_without_copies(spark):
    rows = spark.createDataFrame(
        [(1, "a b", 1, "p"), (2, "ab", 2, "q"), (None, "c", 3, "r"), (None, "c", 3, "r"), (3, " ab ", 4, None)],
        "doc_id long, text string, `row` int, `a.b` string")
    out = grace.without_copies(rows)
    assert out.columns == rows.columns
    assert sorted((r["doc_id"] or 0, r["row"]) for r in out.collect()) in ([(0, 3), (3, 4)],)


def plain_negatives(rows):
    vectors = []
    for at, (vec_id, embedding, label) in enumerate(rows):
        if label is None or embedding is None or any(x is None or not np.isfinite(x) for x in embedding):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        vectors.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in embedding], at))
    last = lambda x: (x is None, x or 0)
    out = []
    for a, la, va, at in vectors:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v, row in vectors if row != at]
        best = sorted((s for s in scored if s[2] == la), key=lambda s: (-s[0], last(s[1])))[:5]
        for score, positive, _ in best:
            inside = sorted((s for s in scored if s[2] != la and 80 * score <= 100 * s[0] <= 100 * score),
                            key=lambda s: (-s[0], last(s[1])))[:5]
            out += [(a, positive, k + 1, n[1], score, n[0]) for k, n in enumerate(inside)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, row long, score string"
NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("sizes", [{}, {"strip_rows": 2, "cell_rows": 37}])
def test_hard_negatives(spark, sizes):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(random.normal(0.2, 0.3, 9), 1)], int(i % 4)) for i in range(420)]
    rows += [(7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 9, 2), (10, [float("inf")], 0),
             (11, [0.5] * 9, None), (None, [0.5] * 9, 1), (None, [0.4] * 9, 0), (12, [], 3), (13, [1.0], 2),
             (100, [0.3] * 12, 2), (100, [0.3] * 12, 2), (900, [-1.0] * 9, 3), (700, None, 3), (800, [0.0] * 9, 1)]
    rows += [(1000 + i, [0.25] * 9, i % 2) for i in range(30)]  # one vector many times
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(5)
    got = negatives.hard_negatives(frame, **sizes).collect()
    assert Counter(tuple(r[c] for c in NEGATIVES) for r in got) == plain_negatives(rows)
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_strassen_is_exact():
    random = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (3, 5, 7), (33, 64, 65), (100, 64, 131), (70, 33, 40), (5, 0, 4)]:
        one = random.integers(-(1 << 28), 1 << 28, (m, k))
        two = random.integers(-(1 << 28), 1 << 28, (n, k))
        for leaf in (1, 4, 32):
            assert (negatives.strassen(one, two, leaf) == one @ two.T).all()
    huge = np.full((40, 40), (1 << 61) + 1, dtype=np.int64)  # intermediate sums wrap, results do not
    unit = np.eye(40, dtype=np.int64)
    assert (negatives.strassen(huge, unit, 2) == huge).all()


def test_heaps_merge_in_any_order():
    rows = [(s % 7, i, 0) for i, s in enumerate(range(0, 300, 11))]
    whole = negatives.Best(6)
    parts = [negatives.Best(6) for _ in range(4)]
    for at, entry in enumerate(rows):
        whole.offer(*entry)
        parts[at % 4].offer(*entry)
    merged = negatives.Best(6)
    for part in reversed(parts):
        merged.merge(part)
    assert merged.ordered() == whole.ordered() == sorted(rows, key=lambda r: (-r[0], r[1]))[:6]


@pytest.mark.parametrize("page", [
    "<a" * 500_000, "<!" * 500_000, "<b>" * 120_000 + "</i>" * 120_000, '<a "' * 250_000 + ">",
    '<a "x" ' * 140_000 + '">"', "<b" * 500_000 + '"x>', "<b>" * 120_000 + "<hr>" * 120_000,
    "<script>" + "</script " * 110_000, "<b>" * 120_000 + "<li>" * 120_000,
    "<i><div>" + "<b>" * 120_000 + "</i>" * 120_000], ids=range(10))
def test_parser_is_linear_on_broken_pages(page):
    """A megabyte of what never closes; a quadratic parser needs hours for some of these."""
    begun = time.process_time()
    tree = dom.parse(page)
    assert tree.tags[0] == "#page" and time.process_time() - begun < 20


def test_broken_markup_is_text():
    for page, want in [("a <b c", "a <b c"), ("x <a 'q>y", "x <a 'q>y"), ("1 < 2 <p>3", "1 < 2 3"),
                       ("a<!-- b", "a"), ("a <x <!-- b", "a <x "), ("a<!--b-->c<?d>e", "ace"), ("a</i>b", "ab")]:
        pieces = dom.parse(page).pieces
        assert "".join(text for _, text, broken in pieces if not broken) == want, page
