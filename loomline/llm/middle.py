"""Fill-in-middle: whole texts cut into prefix, middle and suffix, and put in a new order.

A text's units are runs of ASCII letters and single other code points. Its UTF-8 bytes are
cut into blocks of `BLOCK` bytes; a Fenwick tree over the blocks holds how many units start
in each and how many code points. A cut before unit u is found by binary lifting: one
descent of the tree gives the block that unit starts in, with the units and code points
before it, and only that block is then searched for the boundary. Texts are read once, as
views of the Arrow buffer, and cut by Spark at the code points found.

Which cut and which form a document gets follows from the hash of its id alone, so reruns
and any partitioning agree. Text with a sentinel in it stays plain, so an output can be
taken apart again without knowing the text.

Null texts are empty, and plain. A null id hashes as an empty string. Rows equal in id and
text get equal results; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomline.llm.tables import free_name, full_text

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100: the share that is cut, and of it that with the suffix first
CUTS = ["n", "prefix_chars", "middle_chars"]
CUT_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in CUTS])


class BlockTree:
    """Fenwick tree over the blocks of a text: units that start in a block, its code points."""

    def __init__(self, units: list[int], points: list[int]):
        self.size = len(units)
        self.units, self.points = [0, *units], [0, *points]
        for at in range(1, self.size + 1):
            above = at + (at & -at)
            if above <= self.size:
                self.units[above] += self.units[at]
                self.points[above] += self.points[at]

    def descend(self, unit: int) -> tuple[int, int, int]:
        """The block `unit` starts in (counted from 0), with units and code points before it."""
        block = units = points = 0
        step = 1 << self.size.bit_length() >> 1
        while step:
            after = block + step
            if after <= self.size and units + self.units[after] <= unit:
                block = after
                units += self.units[after]
                points += self.points[after]
            step >>= 1
        return block, units, points


class Units:
    """The units of a UTF-8 text, with a tree over its blocks."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.block = block
        low = data | 0x20
        letters = (low >= ord("a")) & (low <= ord("z"))
        self.points = (data & 0xC0) != 0x80  # the first byte of every code point
        self.starts = self.points.copy()
        self.starts[1:] &= ~(letters[1:] & letters[:-1])
        edges = np.arange(0, len(data), block)
        units, points = (
            np.add.reduceat(marks, edges, dtype=np.int64).tolist() if len(edges) else []
            for marks in (self.starts, self.points))
        self.n, self.chars = sum(units), sum(points)
        self.tree = BlockTree(units, points)

    def chars_before(self, unit: int) -> int:
        """Code points before the start of `unit`; all of them if there are no more units."""
        if unit >= self.n:
            return self.chars
        block, units, points = self.tree.descend(unit)
        begin = block * self.block
        inside = np.flatnonzero(self.starts[begin:begin + self.block])[unit - units]
        return points + int(np.count_nonzero(self.points[begin:begin + inside]))


@F.arrow_udf(CUT_TYPE)
def cut_places(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text, and the code points of prefix and middle by the two draws."""
    rows = []
    for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
        units = Units(np.frombuffer(text.as_buffer(), dtype=np.uint8))
        first, second = sorted((a % (units.n + 1), b % (units.n + 1)))
        before = units.chars_before(first)
        rows.append((units.n, before, units.chars_before(second) - before))
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], CUTS)


def draws(id: Column, seed: str) -> list[Column]:
    """Four whole numbers from the hash of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def middle_form(text: Column, id: Column, seed: str) -> Column:
    third, fourth = draws(id, seed)[2:]
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(sentinel))
    plain = (text == "") | marked | (third % 100 >= PLAIN_FROM)
    return F.when(plain, "plain").when(fourth % 100 < SPM_BELOW, "spm").otherwise("psm")


def assembled(text: Column, form: Column, prefix_chars: Column, middle_chars: Column) -> Column:
    first, second = prefix_chars.cast("int"), middle_chars.cast("int")
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second)
    suffix = F.substring(text, first + second + 1, F.char_length(text))
    p, s, m = (F.lit(sentinel) for sentinel in (PREFIX, SUFFIX, MIDDLE))
    return (
        F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of; a cut text holds no sentinel, so its parts stand apart."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text",
                   seed: str = "1") -> DataFrame:
    """`id, n, form, prefix_chars, middle_chars, output`; the cuts are null where plain.

    Another `seed` gives another form and other cuts, as for another epoch.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), full_text(f"`{text}`").alias("text"))
    one, two = draws(F.col("id"), seed)[:2]
    cut = rows.select("id", "text", middle_form(F.col("text"), F.col("id"), seed).alias("form"),
                      cut_places("text", one, two).alias("cut"))
    at = lambda name: F.when(F.col("form") != "plain", F.col(f"cut.{name}")).alias(name)
    placed = cut.select("id", "text", "cut.n", "form", at("prefix_chars"), at("middle_chars"))
    return placed.select(
        F.col("id").alias(id), "n", "form", "prefix_chars", "middle_chars",
        assembled(F.col("text"), F.col("form"), F.col("prefix_chars"), F.col("middle_chars"))
        .alias("output"))


def middle_corpus(docs: DataFrame, id: str = "doc_id", text: str = "text",
                  seed: str = "1") -> DataFrame:
    """The documents with all their columns, each text in its new form."""
    whole, cut = full_text(f"`{text}`"), free_name(docs, "cut")
    one, two = draws(F.col(f"`{id}`"), seed)[:2]
    placed = docs.withColumn(cut, cut_places(whole, one, two))
    output = assembled(whole, middle_form(whole, F.col(f"`{id}`"), seed),
                       F.col(f"{cut}.prefix_chars"), F.col(f"{cut}.middle_chars"))
    return placed.select(*[
        (output if name == text else F.col(f"`{name}`")).alias(name) for name in docs.columns])


def middle_report(docs: DataFrame) -> DataFrame:
    rows = fill_in_middle(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
