"""Near-duplicate documents by SimHash, with pigeonring filtering of candidates.

A fingerprint has 64 bits; two link at `BUDGET` = 3 or fewer differing bits. Cut into
m = 8 segments on a ring, a linked pair has a segment from which on every chain of
l segments differs in at most floor(3 l / 8) bits: none in the first two, one in the
first five, two in the first seven. So the pair agrees on 16 bits, and of the next 24
bits, where one may differ, on the left or the right 12: 16 keys of 28 bits per
fingerprint. Pairs under a key are checked chain by chain before the whole distance.

Equal fingerprints are one node, however many documents carry them. A key with more
than `BUCKET` fingerprints is never compared as a whole: its fingerprints get longer
keys, a quarter of the free bits each time (three differences leave a quarter equal),
until every bucket is small. This is exact and ends, as free bits run out.

Null and empty texts have no words and the fingerprint zero. Rows equal in every
column share a component. A null doc_id never is the least of a component; one
of null ids only has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomline.llm.components import components
from loomline.llm.tables import quoted
from loomline.staging import stage

BUDGET = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
SHINGLE = 3
SEED = 42
BLOCK = 1 << 16
BUCKET = 512
KEY_BITS = 28
LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def hashes(text: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of words, in blocks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and spaces
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        pairs = zip(starts[at:min(at + BLOCK, count)].tolist(), last[at:at + BLOCK].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash as a signed 64-bit number."""
    ones, count = np.zeros(64, dtype=np.int64), 0
    for block in hashes(text or "", shingle):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        count += len(block)
    set_bits = np.packbits((2 * ones > count).astype(np.uint8), bitorder="little")
    return int(set_bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(text) for text in texts], dtype="int64")


def turned(value: Column, bits: int) -> Column:
    if bits == 0:
        return value
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def lifted(value: Column, fixed: int, part: int, width: int) -> Column:
    """Move `width` bits, `part` * width below the `fixed` top bits, to right below them."""
    if part == 0:
        return value
    free = 64 - fixed
    low = free - (part + 1) * width
    moved = part * width
    mask = lambda size: F.lit((1 << size) - 1)
    top = F.shiftleft(F.shiftrightunsigned(value, free), free) if fixed else F.lit(0)
    piece = F.shiftrightunsigned(value, low).bitwiseAND(mask(width))
    passed = F.shiftrightunsigned(value, low + width).bitwiseAND(mask(moved))
    rest = value.bitwiseAND(mask(low)) if low else F.lit(0)
    out = top.bitwiseOR(F.shiftleft(piece, free - width)).bitwiseOR(F.shiftleft(passed, low))
    return out.bitwiseOR(rest)


def first_keys(fp: Column) -> Column:
    """16 (path, bits): the bits start with the 28 that a linked pair shares on this path."""
    half = (KEY_BITS - 2 * WIDTH)
    return F.array(*[
        F.struct(F.lit(turn * 2 + side).alias("path"),
                 lifted(turned(fp, turn * WIDTH), 2 * WIDTH, side, half).alias("bits"))
        for turn in range(SEGMENTS) for side in (0, 1)
    ])


def longer_keys(fixed: int, width: int) -> Column:
    return F.array(*[
        F.struct((F.col("path") * 4 + part).alias("path"),
                 lifted(F.col("bits"), fixed, part, width).alias("bits"))
        for part in range(BUDGET + 1)
    ])


def chained(one: np.ndarray, two: np.ndarray, turn: int) -> np.ndarray:
    """Which pairs keep the proportional budget of every chain from segment `turn` on."""
    differ = one ^ two
    if turn:
        bits = np.uint64(turn * WIDTH)
        differ = (differ << bits) | (differ >> (np.uint64(64) - bits))
    keep = np.arange(len(differ))
    for length in range(1, SEGMENTS + 1):
        head = differ[keep] >> np.uint64(64 - length * WIDTH)
        keep = keep[np.bitwise_count(head) <= BUDGET * length // SEGMENTS]
        if not len(keep):
            break
    return keep


def bucket_links(members: np.ndarray, turn: int) -> list[tuple[int, int]]:
    """Links of a bucket, less those that others of the bucket already imply."""
    fps = np.unique(members.astype(np.int64)).view(np.uint64)
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for at in range(len(fps) - 1):
        for k in chained(fps[at], fps[at + 1:], turn).tolist():
            a, b = root(at), root(at + 1 + k)
            if a != b:
                parent[b] = a
                links.append((int(fps[at].view(np.int64)), int(fps[at + 1 + k].view(np.int64))))
    return links


@F.pandas_udf(LINKS)
def links_of(turns: pd.Series, members: pd.Series) -> pd.Series:
    return pd.Series([
        [{"a": a, "b": b} for a, b in bucket_links(np.asarray(fps), int(turn))]
        for turn, fps in zip(turns, members)
    ])


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints `fp` within the budget (distinct rows in)."""
    fixed, depth = KEY_BITS, 0
    keyed = prints.select("fp", F.inline(first_keys(F.col("fp"))))
    found = []
    while True:
        free = 64 - fixed
        bucket = bucket if free > BUDGET else max(bucket, 1 << free)  # all that can differ
        headed = keyed.withColumn("head", F.shiftrightunsigned("bits", free))
        counts = stage(
            headed.groupBy("path", "head").count().where("count > 1"), "bucket-sizes"
        )
        shared = headed.join(counts, ["path", "head"])
        cold = (
            shared.where(F.col("count") <= bucket).groupBy("path", "head")
            .agg(F.collect_list("fp").alias("members"))
        )
        turn = F.shiftright("path", 2 * depth + 1)
        found.append(stage(
            cold.select(F.inline(links_of(turn, F.col("members")))).distinct(), "bucket-links"
        ))
        if counts.where(F.col("count") > bucket).isEmpty():
            break
        width = free // (BUDGET + 1)
        hot = shared.where(F.col("count") > bucket).select("fp", "path", "bits")
        keyed = stage(hot.select("fp", F.inline(longer_keys(fixed, width))), "longer-keys")
        fixed, depth = fixed + width, depth + 1
    return reduce(DataFrame.union, found).distinct()


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def rooted_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp, text_hash, root and component_id of every row; a root names a component."""
    marked = stage(docs.select("doc_id", fingerprint_of(F.col(text)).alias("fp"),
                               text_hash(text).alias("text_hash")), "prints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row, the least doc_id reachable over links."""
    return rooted_rows(docs, text).select("doc_id", "fp", "component_id")


def duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents less near copies: of each component one row stays.

    It is that of least doc_id, null last, then of least text hash, then of least hash
    over all columns but maps. So a row with a null doc_id stays only where its whole
    component has none, and every component keeps a row, whatever ids it shares with others.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"),
                           F.col("text_hash").alias("hash")))
    kept = stage(rooted_rows(docs).groupBy("root").agg(least.alias("least"))
                 .select(F.col("least.id").alias("kept_id"),
                         F.col("least.hash").alias("kept_hash")), "kept")
    comparable = [quoted(c) for c, kind in docs.dtypes if "map<" not in kind]
    packed = docs.select("doc_id", text_hash().alias("text_hash"),
                         F.xxhash64(*comparable).alias("order"),
                         F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    same = (F.col("doc_id").eqNullSafe(F.col("kept_id"))
            & (F.col("text_hash") == F.col("kept_hash")))
    survivors = packed.join(kept, same, "left_semi")
    return (survivors.groupBy("doc_id", "text_hash")
            .agg(F.min_by("row", "order").alias("row")).select("row.*"))
