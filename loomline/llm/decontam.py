"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Each benchmark item is cut into windows of `WINDOW` words (a shorter item is one
window), and each window into shingles of `SHINGLE` words (a shorter window is one
shingle). A document contains a window only if it contains all its shingles, so by the
prefix filter the first in a global order of rarity is enough to find candidates. Two
scans of the texts do the work:

1. `frequencies` counts how often each benchmark shingle stands in the corpus.
2. `occurrences` joins every position of a text to the one rarest shingle of each
   window. A candidate must begin inside the document and fit into it (length and
   positional bounds) and is verified exactly, word by word, against the words around.

Windows with a shingle that stands nowhere are never joined. Shingles are joined by
their hash; what the hash lets through falls to the verification, and a wrong count
would only change the order. The same scan brings each document's number of words: the
empty window stands once at the end of every text. Texts never leave the task that
reads them: the tables of shingles are broadcast in blocks of at most `BLOCK_BYTES`,
measured; a benchmark of several blocks is one more read of the texts for each.

Null texts have no words. A null item_id is the empty string in the list of ids. Rows
equal in doc_id and text get equal results. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.llm.tables import ascii_lower, free_name, full_text
from loomline.staging import stage

WINDOW = 13
SHINGLE = 5
SHARE = 20
BEFORE = WINDOW - SHINGLE  # words of a window that can precede its rarest shingle
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 32 << 20
ROW_BYTES = 40  # of a row beside its words
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (item_id, window, size) with the words of a window joined by spaces."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        words_of(full_text()).alias("words"),
    ).where(F.size("words") > 0)
    size = F.least(F.lit(WINDOW), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    cut = items.select("item_id", "words", size.alias("size"), F.explode(starts).alias("at"))
    return cut.select(
        "item_id", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("window"),
        "size",
    ).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """Rows (window, size, offset, shingle): the hashes of all shingles of each window."""
    width = F.least(F.lit(SHINGLE), F.col("size"))
    placed = windows.select(
        "window", "size", width.alias("width"),
        F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("offset"))
    return placed.select("window", "size", "width", "offset", F.xxhash64(
        F.slice(F.split("window", " "), F.col("offset") + 1, F.col("width"))).alias("shingle"))


def blocks(df: DataFrame, row_bytes: Column, key: str) -> list[DataFrame]:
    """The rows of a staged table as broadcasts of at most about `BLOCK_BYTES` each."""
    total = df.agg(F.sum(row_bytes).alias("bytes")).first()["bytes"] or 0
    count = -(-total // BLOCK_BYTES) or 1
    part = F.pmod(F.xxhash64(key), F.lit(count))
    return [F.broadcast(df.where(part == at) if count > 1 else df) for at in range(count)]


def positions(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, pos, before, around, shingle), one or more for every
    position of a text and one for its end, where the shingle is empty.

    `around` are the words that a window with this shingle can cover, `before` those of
    them that come before it.
    """
    texts = docs.select("doc_id", F.xxhash64(full_text()).alias("text_hash"),
                        words_of(full_text()).alias("words"))
    placed = texts.select(*KEY, "words", F.size("words").alias("n_words"),
                          F.explode(F.sequence(F.lit(0), F.size("words"))).alias("pos"))
    before = F.least(F.col("pos"), F.lit(BEFORE))
    hashes = [F.xxhash64(F.slice("words", F.col("pos") + 1, width)) for width in widths]
    shingle = hashes[0] if len(hashes) == 1 else F.explode(F.array_distinct(F.array(*hashes)))
    return placed.select(
        *KEY, "n_words", "pos", before.alias("before"),
        F.slice("words", F.col("pos") - before + 1, BEFORE + WINDOW).alias("around"),
        shingle.alias("shingle"),
    )


def frequencies(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """How often each of the shingles stands in the corpus, 0 left out."""
    known = stage(shingles.select("shingle").distinct(), "benchmark-shingles")
    met = [positions(docs, widths).select("shingle").join(block, "shingle")
           for block in blocks(known, F.lit(ROW_BYTES), "shingle")]
    return reduce(DataFrame.union, met).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("frequency"))


def prefixes(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """The rarest shingle of each window (ties: the first) that may occur at all."""
    placed = stage(window_shingles(windows), "window-shingles")
    counted = stage(frequencies(docs, placed, widths), "shingle-frequencies")
    return (
        placed.join(counted, "shingle", "left")
        .groupBy("window", "size").agg(F.min(F.struct(
            F.coalesce("frequency", F.lit(0)).alias("frequency"), "offset", "shingle",
        )).alias("rarest"))
        .where("rarest.frequency > 0")
        .select("window", "size", "rarest.offset", "rarest.shingle")
    )


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every place where a window occurs: doc_id, text_hash, n_words, start (from 0), size, window.

    Besides one row of size 0 for every document, with the empty window at its end.
    """
    windows = stage(item_windows(benchmark).select("window", "size").distinct(), "windows")
    widths = sorted(row["width"] for row in windows.select(
        F.least(F.lit(SHINGLE), "size").alias("width")).distinct().collect())  # at most SHINGLE
    widths = widths or [SHINGLE]
    end = docs.sparkSession.range(1, numPartitions=1).select(
        F.lit("").alias("window"), F.lit(0).alias("size"), F.lit(0).alias("offset"),
        F.xxhash64(F.array().cast("array<string>")).alias("shingle"))
    wanted = stage(prefixes(docs, windows, widths).union(end), "prefix-shingles")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    there = F.array_join(
        F.slice("around", F.col("before") - F.col("offset") + 1, F.col("size")), " ")
    found = [
        positions(docs, widths).join(block, "shingle")
        .where(F.when(inside, there == F.col("window")))
        .select(*KEY, "n_words", start.alias("start"), "size", "window")
        for block in blocks(wanted, F.octet_length("window") + ROW_BYTES, "window")
    ]
    return stage(reduce(DataFrame.union, found), "occurrences")


def covered(places: DataFrame) -> DataFrame:
    """Words hit per document: the length of the union of its windows."""
    earlier = Window.partitionBy(*KEY).orderBy("start", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    return (
        places.select(*KEY, "start", "size").distinct()
        .select(*KEY, F.greatest(fresh, F.lit(0)).alias("fresh"))
        .groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, items with occurring windows and their ids."""
    found = occurrences(docs, benchmark)
    places = found.where("size > 0")
    items = (
        places.select(*KEY, "window").distinct().join(item_windows(benchmark), "window")
        .groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    named = {"doc_id": "d", "text_hash": "t"}
    hits = stage(covered(places).join(items.withColumnsRenamed(named), same).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_hit", "items"), "hits")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return found.where("size = 0").join(hits, same, "left").select(
        *KEY, F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        listed.alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    marked = contamination(docs.select("doc_id", "text"), benchmark).where("contaminated")
    bad_id, bad_hash = free_name(docs, "bad_id"), free_name(docs, "bad_hash")
    bad = stage(marked.select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
                .distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64(full_text()) == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
