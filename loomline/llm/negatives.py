"""Hard negatives: exact integer scores by Strassen's multiplication, best rows by heaps.

Vectors become whole numbers, floor(256 x). Anchors are dealt into strips and all rows into
cells of bounded size; a task takes one strip and one cell, so neither side is ever whole
anywhere. Inside it, tiles of the strip and of the cell are multiplied by Strassen's
recursion in int64 with zero padding: seven half-size products and exact additions per
level, down to `LEAF`. Sums and products wrap at 64 bits alike, so a score is exact
whenever it fits into 64 bits itself, whatever the intermediate sums.

Positives and negatives are held in bounded heaps, one per anchor and one per anchor and
score window: the best rows of a tile are offered to the cell's heap, heaps of the same
anchor merge across cells by the same order. Positives take one pass over pairs of equal
label; the windows they open take a second pass over pairs of different labels.

Rows with a null label, a null vector or a null or non-finite component take no part. Ties
in score go to the smaller id, null last. Repeated rows are rows of their own: each takes
its place among the best, and repeated anchors each give their result. Shorter vectors
count as padded with zeros. A positive of negative score opens no window.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomline.operators.dedup import topk_per
from loomline.staging import stage

LEAF = 32
STRIP_ROWS, CELL_ROWS = 1024, 8192
TILE = 1024
SCALE = 256
POSITIVES = NEGATIVES = 5
ANCHORS, MOVED, LABELS = 100, 7, 10
NO_ID = 1 << 63  # after every id

POSITIVE = ("anchor long, anchor_id long, positive long, positive_id long, positive_score long")
NEGATIVE = ("anchor long, anchor_id long, turn int, positive_id long, positive_score long, "
            "negative long, negative_id long, negative_score long")


def halves(matrix: np.ndarray) -> list[np.ndarray]:
    """The four quarters of a matrix, after zero padding to even sides."""
    rows, columns = matrix.shape
    if rows % 2 or columns % 2:
        matrix = np.pad(matrix, ((0, rows % 2), (0, columns % 2)))
    r, c = matrix.shape[0] // 2, matrix.shape[1] // 2
    return [matrix[:r, :c], matrix[:r, c:], matrix[r:, :c], matrix[r:, c:]]


def strassen(one: np.ndarray, two: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Inner products of the rows of `one` with the rows of `two`, in int64."""
    if min(*one.shape, *two.shape) <= leaf:
        return one @ two.T
    a11, a12, a21, a22 = halves(one)
    b11, b21, b12, b22 = halves(two)  # quarters of the transposed second factor
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m1.shape[0], 2 * m1.shape[1]), dtype=np.int64)
    r, c = m1.shape
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:len(one), :len(two)]


class Best:
    """A bounded heap of (score, id, row), the worst on top; heaps merge in any order."""

    def __init__(self, size: int):
        self.size, self.heap = size, []

    def offer(self, score: int, id: int, row: int) -> None:
        entry = (score, -id, -row)
        if len(self.heap) < self.size:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def merge(self, other: "Best") -> None:
        for score, id, row in other.heap:
            self.offer(score, -id, -row)

    def ordered(self) -> list[tuple[int, int, int]]:
        return [(score, -id, -row) for score, id, row in sorted(self.heap, reverse=True)]


class Side:
    """Rows of a task as arrays, by id; vectors as one zero-padded matrix."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        self.ids = [NO_ID if x is None else x for x in table["vec_id"].to_pylist()]
        self.rows = table["row"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.table = table
        vectors = table["vector"].combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy().astype(np.int64)
        self.matrix = np.zeros((len(sizes), width), dtype=np.int64)
        self.matrix[np.arange(width) < sizes[:, None]] = flat

    @staticmethod
    def width(*tables: pa.Table) -> int:
        return max([1, *(len(x) for table in tables for x in table["vector"])])


def whole_id(id: int) -> int | None:
    return None if id == NO_ID else id


def columns(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [part.split() for part in ddl.split(", ")]
    values = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(column, kinds[kind])
                     for (name, kind), column in zip(fields, values)})


def tiles(n: int) -> list[slice]:
    return [slice(at, min(at + TILE, n)) for at in range(0, n, TILE)]


def positive_heaps(size: int):
    """Tasks over (strip, cell): the best rows of the anchor's label, per anchor."""
    def run(anchors: pa.Table, cell: pa.Table) -> pa.Table:
        if not len(anchors) or not len(cell):
            return columns([], POSITIVE)
        width = Side.width(anchors, cell)
        left, right = Side(anchors, width), Side(cell, width)
        heaps: dict[int, Best] = defaultdict(lambda: Best(size))
        for label in np.unique(left.labels):
            own, others = np.flatnonzero(left.labels == label), np.flatnonzero(right.labels == label)
            for tile in tiles(len(others)):
                at = others[tile]
                scores = strassen(left.matrix[own], right.matrix[at])
                # Ids ascend, so a stable order of scores puts ties by id; one may be the anchor.
                first = np.argsort(-scores, axis=1, kind="stable")[:, :size + 1]
                for i, anchor in enumerate(own.tolist()):
                    found = Best(size)
                    for j in first[i].tolist():
                        if right.rows[at[j]] != left.rows[anchor]:
                            found.offer(int(scores[i, j]), right.ids[at[j]], int(right.rows[at[j]]))
                    heaps[anchor].merge(found)
        return columns([
            (int(left.rows[anchor]), whole_id(left.ids[anchor]), row, whole_id(id), score)
            for anchor, heap in heaps.items() for score, id, row in heap.ordered()], POSITIVE)
    return run


def window(score: int) -> tuple[int, int]:
    """Least and largest score s with 80 score <= 100 s <= 100 score; empty below zero."""
    return -(-4 * score // 5), score


def negative_heaps(size: int):
    """Tasks over (strip, cell): the best rows of other labels in each window, per anchor."""
    def run(anchors: pa.Table, cell: pa.Table) -> pa.Table:
        if not len(anchors) or not len(cell):
            return columns([], NEGATIVE)
        width = Side.width(anchors, cell)
        left, right = Side(anchors, width), Side(cell, width)
        opened = left.table["positives"].to_pylist()
        heaps: dict[tuple[int, int], Best] = defaultdict(lambda: Best(size))
        for tile in tiles(len(right.rows)):
            scores = strassen(left.matrix, right.matrix[tile])
            labels = right.labels[tile]
            for anchor, row in enumerate(scores):
                bounds = [window(positive["score"]) for positive in opened[anchor]]
                least, most = min(low for low, _ in bounds), max(high for _, high in bounds)
                inside = np.flatnonzero(
                    (row >= least) & (row <= most) & (labels != left.labels[anchor]))
                inside = inside[np.argsort(-row[inside], kind="stable")]
                falling = row[inside]
                for turn, (low, high) in enumerate(bounds):
                    begin = int(np.searchsorted(-falling, -high))
                    for j, score in zip(inside[begin:begin + size].tolist(),
                                        falling[begin:begin + size].tolist()):
                        if score < low:
                            break
                        at = tile.start + j
                        heaps[anchor, turn].offer(score, right.ids[at], int(right.rows[at]))
        return columns([
            (int(left.rows[anchor]), whole_id(left.ids[anchor]), turn, opened[anchor][turn]["id"],
             opened[anchor][turn]["score"], row, whole_id(id), score)
            for (anchor, turn), heap in heaps.items() for score, id, row in heap.ordered()], NEGATIVE)
    return run


def whole_vectors(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, vector: the rows that take part, as whole numbers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    moved = F.when(F.coalesce(F.col("vec_id") % MOVED == 0, F.lit(False)), (label + 1) % LABELS)
    taken = rows.select("vec_id", "label", "embedding").where(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    return stage(taken.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(moved, label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector")),
        "vectors")


def dealt(name: str, groups: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(groups).cast("long")).alias(name)


def every(name: str, groups: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias(name)


def met(anchors: DataFrame, vectors: DataFrame, run, ddl: str, strip_rows: int,
        cell_rows: int) -> DataFrame:
    """`run` over every strip of anchors with every cell of rows."""
    strips = max(1, -(-anchors.count() // strip_rows))
    cells = max(1, -(-vectors.count() // cell_rows))
    left = anchors.withColumn("strip", dealt("strip", strips)).select("*", every("cell", cells))
    right = vectors.withColumn("cell", dealt("cell", cells)).select("*", every("strip", strips))
    return left.groupBy("strip", "cell").cogroup(right.groupBy("strip", "cell")).applyInArrow(run, ddl)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   anchors: int = ANCHORS, strip_rows: int = STRIP_ROWS,
                   cell_rows: int = CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    vectors = whole_vectors(rows)
    chosen = vectors.where(F.col("vec_id") % anchors == 0)
    ahead = lambda name: [F.desc(f"{name}_score"), F.asc_nulls_last(f"{name}_id"), F.asc(name)]
    best = stage(topk_per(
        met(chosen, vectors, positive_heaps(positives), POSITIVE, strip_rows, cell_rows),
        ["anchor"], ahead("positive"), positives, column="turn"), "positives")
    opened = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(
        F.struct("turn", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))))
        .alias("positives"))
    asking = stage(chosen.join(opened, "row"), "asking-anchors")
    found = topk_per(
        met(asking, vectors, negative_heaps(negatives), NEGATIVE, strip_rows, cell_rows),
        ["anchor", "turn"], ahead("negative"), negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                        "negative_id", "positive_score", "negative_score")


def negatives_report(embeddings: DataFrame) -> DataFrame:
    return hard_negatives(embeddings)
