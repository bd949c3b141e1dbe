"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Nodes are described by subtree text density, attribute tokens, depth and sibling
statistics. No page comes with labels, so the trees learn from a bounded sample of
pages (`sample_pages`, chosen by hash): pages whose markup names their parts give
labels by that markup, and each is also rebuilt `variants` times from its own words
with other wrappers and with menus, notices, adverts, forms, side columns and reader
comments in many spellings, or none, so that the choice does not hang on one tag name.
MLlib fits the trees; they are read out once and travel with the scan of all pages.

The decoding keeps a set of nodes closed upwards: nothing inside a rejected node is
kept, and no ancestor of a kept node is rejected. Scripts, styles and other parts that
are never shown are left out beforehand.

Null and empty pages have no text. Broken markup is repaired. Every page is read
whole; repeated pages get equal texts. Without any page to learn from, nodes are
judged by their markup's names alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from loomline.llm import dom
from loomline.llm.tables import hash_sample
from loomline.staging import stage

SAMPLE_PAGES = 300
VARIANTS = 3
ROUNDS = 20
DEPTH = 4
KEEP = "data-k"  # marks known parts of rebuilt pages while labels are read


def markup_labels(tree: dom.Tree) -> list[int | None]:
    """1 in or around an article, 0 in parts named as something else, None where unknown."""
    n = len(tree.tags)
    labels: list[int | None] = [None] * n
    main = [False] * n
    for node in range(1, n):
        parent = tree.parents[node]
        tag, names = tree.tags[node], tree.tokens[node]
        if labels[parent] == 0 or tag in ("nav", "footer", "aside", "form", "header") or any(
                name in dom.ASIDE for name in names):
            labels[node] = 0
        elif main[parent] or tag in ("article", "main"):
            labels[node], main[node] = 1, True
    if any(main):
        for node in range(n - 1, 0, -1):
            if labels[node] == 1:
                up = tree.parents[node]
                while up > 0 and labels[up] is None:
                    labels[up] = 1
                    up = tree.parents[up]
    return labels


def rebuilt(paragraphs: list[str], dice: random.Random) -> str:
    """A page of the given texts in a random layout; `keep` and `drop` tell its parts."""
    pick = dice.choice
    words = " ".join(paragraphs).split() or ["text"]

    def few(low: int, high: int) -> str:
        start = dice.randrange(len(words))
        return escape(" ".join((words * 2)[start:start + dice.randint(low, high)]))

    def name(*options: str) -> str:
        chosen = pick([*options, ""])
        return f' {pick(["class", "id"])}="{chosen}"' if chosen else ""

    def links(count: int) -> str:
        return "".join(f'<li><a href="/x">{few(1, 3)}</a></li>' for _ in range(count))

    def part(tag: str, attribute: str, body: str) -> str:
        return f"<{tag}{attribute} drop>{body}</{tag}>"

    def comments() -> str:
        many = "".join(
            f'<div class="{pick(["comment", "reply", "comment-body"])}">'
            f"<b>{few(1, 2)}</b><p>{few(5, 60)}</p></div>" for _ in range(dice.randint(1, 5)))
        named = pick([' class="comments"', ' id="comments"', ' class="discussion"',
                      ' id="respond"', ' class="comment-list"'])
        return part(pick(["section", "div", "ol"]), named, f"<h3>{few(1, 3)}</h3>{many}")

    advert = lambda: part(pick(["div", "aside", "section"]), pick(
        [' class="ad"', ' class="ads"', ' class="advert"', ' id="sponsored"', ' class="promo"',
         ' class="ad-banner"']), pick([few(3, 20), f"<p>{few(5, 30)}</p>"]))
    notice = lambda: part("div", pick(
        [' class="cookie-notice"', ' class="notice"', ' role="alert"', ' id="consent"',
         ' class="alert banner"']), f"<p>{few(5, 30)}</p><button>{few(1, 2)}</button>")
    form = lambda: part("form", name("search", "signup", "newsletter"),
                        f"<label>{few(1, 4)}</label><input>" + pick(["", f"<p>{few(3, 15)}</p>"]))
    menu = lambda: part(pick(["nav", "nav", "div"]), pick(
        [' class="menu"', ' id="nav"', ' role="navigation"']), f"<ul>{links(dice.randint(2, 9))}</ul>")
    header = lambda: part("header", name("header", "masthead", "top"),
                          f"<h2>{few(1, 4)}</h2>" + pick(["", f"<p>{few(3, 12)}</p>"]))
    side = lambda: part(pick(["aside", "div", "section"]), pick(
        [' class="sidebar"', ' id="sidebar"', ' class="related"', ' class="widget"']),
        f"<h3>{few(1, 3)}</h3>" + pick([f"<ul>{links(4)}</ul>", f"<p>{few(8, 50)}</p>"]))
    footer = lambda: part(pick(["footer", "footer", "div"]), pick(
        [' class="footer"', ' id="footer"', ' role="contentinfo"']),
        pick([f"&copy; {few(1, 8)}", f"<p>{few(5, 30)}</p><ul>{links(3)}</ul>"]))
    shapes = [
        lambda t: f"<p keep>{t}</p>", lambda t: f"<p keep>{t}", lambda t: f"<p keep>{t}</p>",
        lambda t: f"<p keep><b keep>{t}<br>", lambda t: f"<div keep>{t}</div>",
        lambda t: f"<blockquote keep><p keep>{t}</p></blockquote>",
        lambda t: f"<ul keep><li keep>{t}</li><li keep>{few(3, 20)}</li></ul>",
        lambda t: f'<p keep>{t} <a href="/y" keep>{few(1, 4)}</a> {few(2, 9)}.</p>',
        lambda t: f"<h2 keep>{few(2, 8)}</h2><p keep>{t}</p>",
        lambda t: f"<table keep><tr keep><td keep>{few(1, 5)}</td><td keep>{t}</td></tr></table>",
    ]
    inside = [f"<h1 keep>{few(3, 12)}</h1>"]
    inner = pick([[], [], [], [advert, side, form, notice]])
    for text in paragraphs:
        inside.append(pick(shapes[:4] if dice.random() < 0.6 else shapes)(escape(text)))
        if inner and dice.random() < 0.25:
            inside.append(pick(inner)())
    wrapper, attribute = pick([
        ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'),
        ("div", ' id="main"'), ("div", ' class="entry-content"'), ("section", ' class="story"'),
        ("div", ""), ("div", ' class="post-body"')])
    if dice.random() < 0.25:
        inside.append(comments())
    content = f"<{wrapper}{attribute} keep>{''.join(inside)}</{wrapper}>"
    if dice.random() < 0.3:
        content = f"<div{name('wrap', 'page', 'container')} keep>{content}</div>"
    maybe = lambda make, chance: make() if dice.random() < chance else ""
    body = (maybe(header, 0.5) + maybe(menu, 0.8) + maybe(notice, 0.4) + maybe(advert, 0.5)
            + maybe(side, 0.2) + content + maybe(comments, 0.35) + maybe(form, 0.3)
            + maybe(side, 0.4) + maybe(advert, 0.2) + maybe(footer, 0.85))
    return f"<html keep><head><title>{few(2, 6)}</title></head><body keep>{body}</body></html>"


def rebuilt_labels(page: str) -> tuple[dom.Tree, list[int | None]]:
    """Parse a rebuilt page; its marks become labels and leave no attribute tokens."""
    marked = page.replace(" keep>", ' role="qqkeep">').replace(" drop>", ' role="qqdrop">')
    tree = dom.parse(marked)
    labels: list[int | None] = [None]
    for node in range(1, len(tree.tags)):
        names = tree.tokens[node]
        up = labels[tree.parents[node]]
        labels.append(0 if "qqdrop" in names or up == 0 else 1 if "qqkeep" in names else None)
        tree.tokens[node] = tuple(x for x in names if not x.startswith("qq"))
    return tree, labels


def teaching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled node features of sampled pages and of their rebuilt variants."""
    for batch in batches:
        for text in batch["html"]:
            tree = dom.parse(text)
            labels = markup_labels(tree)
            examples = [(tree, labels)]
            known = dom.text_of(tree, [label == 1 for label in labels]) or dom.text_of(
                tree, [not x for x in dom.hidden(tree)])
            lines = known.split("\n")
            dice = random.Random(len(known) * 31 + sum(known[:200].encode()))
            for _ in range(VARIANTS):
                if lines:
                    some = dice.sample(lines, min(len(lines), dice.randint(1, 12)))
                    examples.append(rebuilt_labels(rebuilt(some, dice)))
            for one, marks in examples:
                rows = [i for i, mark in enumerate(marks)
                        if mark is not None and one.tags[i] not in dom.HIDDEN]
                if rows:
                    matrix = dom.features(one)[rows]
                    yield pd.DataFrame({"label": [float(marks[i]) for i in rows],
                                        "x": list(matrix.astype(float))})


def flat_trees(model: GBTClassificationModel) -> list[tuple[float, list[tuple]]]:
    """(weight, nodes) of every tree; a node is (feature, threshold, left, right, value)."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees):
        nodes: list[tuple] = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(())
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, at, at, float(node.prediction()))
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
            return at

        walk(tree._java_obj.rootNode())
        out.append((float(weight), nodes))
    return out


def sampled(pages: DataFrame, sample_pages: int) -> DataFrame:
    """At most `sample_pages` different pages, however often each stands in the table."""
    keyed = pages.where("html IS NOT NULL AND html <> ''").select(
        "html", F.xxhash64("html").alias("_hash"), F.char_length("html").alias("_chars"))
    different = stage(keyed.select("_hash", "_chars").distinct(), "page-keys")
    chosen = stage(hash_sample(different, F.col("_hash"), sample_pages), "sample-keys")
    return (
        keyed.join(chosen, ["_hash", "_chars"], "left_semi")
        .groupBy("_hash", "_chars").agg(F.first("html").alias("html")).select("html")
    )


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[tuple[float, list[tuple]]]:
    """Boosted trees from at most `sample_pages` different pages."""
    sample = stage(sampled(pages, sample_pages).repartition(8, F.xxhash64("html")), "sample-pages")
    nodes = stage(sample.select("html").mapInPandas(teaching, "label double, x array<double>"),
                  "nodes")
    if nodes.select("label").distinct().count() < 2:
        return []
    rows = nodes.select("label", array_to_vector("x").alias("features"))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=7, stepSize=0.3, maxBins=32,
                          minInstancesPerNode=5)
    return flat_trees(trees.fit(rows))


def log_odds(matrix: np.ndarray, trees: list[tuple[float, list[tuple]]]) -> np.ndarray:
    """Twice the boosted margin, which is the log-odds under logistic loss."""
    if not trees:  # names alone
        return 1.0 - 2.0 * np.maximum(matrix[:, 18], matrix[:, 20]) - 2.0 * matrix[
            :, dom.NUMBERS:dom.NUMBERS + 5].sum(axis=1)
    total = np.zeros(len(matrix))
    rows = np.arange(len(matrix))
    for weight, nodes in trees:
        feature = np.array([node[0] for node in nodes])
        threshold = np.array([node[1] for node in nodes])
        left = np.array([node[2] for node in nodes])
        right = np.array([node[3] for node in nodes])
        value = np.array([node[4] for node in nodes])
        at = np.zeros(len(matrix), dtype=int)
        for _ in range(DEPTH):
            used = feature[at]
            low = matrix[rows, np.maximum(used, 0)] <= threshold[at]
            at = np.where(low, left[at], right[at])
        total += weight * value[at]
    return 2 * total


def main_text(page: str | None, trees: list[tuple[float, list[tuple]]]) -> str:
    tree = dom.parse(page)
    if len(tree.tags) == 1:
        return dom.text_of(tree, [True])
    return dom.text_of(tree, dom.decode(tree, log_odds(dom.features(tree), trees)))


def extractor(trees: list[tuple[float, list[tuple]]]):
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, trees) for page in pages], dtype=object)

    return extract


def extracted(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """All columns of `pages` with the main text as `__main_text`."""
    return pages.withColumn("__main_text", extractor(fit(pages, sample_pages))(F.col("html")))


def extraction_report(pages: DataFrame) -> DataFrame:
    rows = extracted(pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("__main_text").alias("text"),
                       F.char_length("__main_text").cast("long").alias("n_chars"))
