"""Mixing sources to target weights by Pareto order sampling.

Sources share the corpus's words by weight; a target stops at `most` times its
source's size and the excess is shared again among the others. A document's
expected copies are its source's target over its size. The whole part is taken
for certain; the fraction left is the document's inclusion probability in a
fixed-size sample, drawn by Pareto order: rank by random odds over inclusion
odds and take from the least rank on until the words still missing are reached.
The document that would overshoot is replaced by the one, of those left over,
whose length comes nearest to what is missing, if any comes nearer than none.

Everything is decided per source: a limit rank, and the document that fits best.
So the documents themselves are never shuffled; a source with a third of all rows
costs its share of a scan. Limits come from word counts per source and bucket of
ranks; only the one bucket the limit falls into is sorted.

A draw depends on the seed, the doc_id, the text and, among rows equal in source,
doc_id and text, on the row's number, so each of them is drawn for itself. Only such
rows are numbered, in range partitions that split a group of any size.

Null sources form a source of their own, last in order. Null texts have no words and
draw as empty ones, null doc_ids as empty strings. A source without words has target 0.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.llm.tables import full_text, quoted
from loomline.operators.ordinals import number_rows
from loomline.staging import stage

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SAME = ["source", "doc_id", "_hash"]
PLACE = ["_rank", "doc_id", "_hash", "_copy"]  # order within a source


def words() -> Column:
    return F.regexp_count(full_text(), F.lit(WORD)).cast("long")


def text_name() -> Column:
    return F.md5(full_text())


def same_row(side: str) -> Column:
    """Equal source, doc_id and text, against columns named with `side` before them."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{side}{c}")) for c in SAME])


def numbered(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Add `_copy`: the number, from 0, among rows equal in source, doc_id and text.

    `repeats` names the groups of two rows and more.
    """
    groups = repeats.select(*[F.col(c).alias(f"_of{c}") for c in SAME])
    alone = rows.join(groups, same_row("_of"), "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    again = rows.join(groups, same_row("_of"), "left_semi").withColumn(
        "_row", F.monotonically_increasing_id())
    counted = number_rows(again, [F.col("_row")], by=SAME, column="_copy", start=0)
    return alone.unionByName(counted.drop("_row"))


def draw(seed: str) -> Column:
    """A number in (0, 1) for a row, the same in every run."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    label = F.concat_ws(":", F.lit(seed), name, F.col("_hash"), F.col("_copy").cast("string"))
    digits = F.conv(F.substring(F.md5(label), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight, held back
    at `most` times the size."""
    ordered = number_rows(sizes, [F.col("source").asc_nulls_last()], column="_at", start=0)
    cycle = F.array(*[F.lit(weight) for weight in weights])
    weighted = stage(
        ordered.select("source", "source_size",
                       F.get(cycle, (F.col("_at") % len(weights)).cast("int")).alias("weight")),
        "mix-sources",
    )
    size, weight = F.col("source_size"), F.col("weight")
    whole = weighted.agg(F.sum(size).alias("words"), F.sum(weight).alias("weight")).first()
    words_left, weight_left = whole["words"] or 0, whole["weight"] or 1
    while True:  # each pass holds back at least one more source
        share = F.lit(float(words_left)) / F.lit(float(weight_left))
        held = (size * most) < weight * share
        sums = weighted.agg(
            F.coalesce(F.sum(F.when(held, size * most)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(held, weight)), F.lit(0)).alias("weight"),
        ).first()
        now = (whole["words"] or 0) - sums["words"], (whole["weight"] or 1) - sums["weight"]
        if now == (words_left, weight_left) or now[1] <= 0:
            break
        words_left, weight_left = now
    share = F.lit(float(words_left)) / F.lit(float(weight_left))
    return weighted.select(
        "source", "source_size",
        F.least((size * most).cast("double"), weight * share).alias("target"),
    )


def ranked(docs: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add size, whole copies, and the Pareto rank of the fraction; keeps all columns."""
    size, target = F.col("source_size"), F.col("target")
    ratio = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    chance = F.col("_chance")
    random = F.col("_u")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rank = F.when(chance > 0, (random / (1 - random)) / (chance / (1 - chance)))
    return (
        joined.withColumn("_whole", F.floor(ratio))
        .withColumn("_missing", target - F.col("_whole") * size)
        .withColumn("_chance", ratio - F.col("_whole"))
        .withColumn("_u", draw(seed))
        .withColumn("_rank", rank)
        .withColumn("_bucket", F.floor(F.lit(BUCKETS) * F.col("_rank") / (1 + F.col("_rank"))))
        .drop("_u", "_chance")
    )


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
                seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Per source: size, target, the last rank taken, and the row that fills the gap; and
    the groups of rows equal in source, doc_id and text."""
    narrow = stage(
        docs.select("doc_id", "source", words().alias("size"), text_name().alias("_hash")),
        "mix-narrow",
    )
    repeats = stage(
        narrow.groupBy(*SAME).count().where(F.col("count") > 1).select(*SAME), "mix-repeats"
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, most), "mix-targets")
    rows = ranked(stage(numbered(narrow, repeats), "mix-numbered"), targets, seed).where(
        "_rank IS NOT NULL")
    same = lambda side: F.col("source").eqNullSafe(F.col(side))

    histogram = rows.groupBy("source", "_bucket").agg(
        F.sum("size").alias("_words"), F.first("_missing").alias("_missing")
    )
    so_far = Window.partitionBy("source").orderBy("_bucket")
    summed = histogram.withColumn("_to", F.sum("_words").over(so_far))
    limits = stage(
        summed.where(F.col("_to") > F.col("_missing")).groupBy("source")
        .agg(F.min_by(F.struct("_bucket", (F.col("_to") - F.col("_words")).alias("_before"),
                               "_missing"), "_bucket").alias("_at"))
        .select(F.col("source").alias("_s"), F.col("_at._bucket").alias("_cut"),
                F.col("_at._before").alias("_before"), F.col("_at._missing").alias("_need")),
        "mix-limits",
    )
    edge = rows.join(limits, same("_s") & (F.col("_bucket") == F.col("_cut")))
    within = Window.partitionBy("source").orderBy(*PLACE)
    taken = (
        edge.withColumn("_run", F.sum("size").over(within) + F.col("_before"))
        .where(F.col("_run") <= F.col("_need"))
        .groupBy(F.col("source").alias("_t"))
        .agg(F.max(F.struct(*PLACE)).alias("_last"), F.max("_run").alias("_reached"))
    )
    cuts = stage(
        limits.join(taken, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
            "_s", "_cut", "_last",
            (F.col("_need") - F.coalesce("_reached", "_before")).alias("_gap"),
        ),
        "mix-cuts",
    )
    over = rows.join(cuts, same("_s")).where(~chosen())
    off = F.abs(F.col("size") - F.col("_gap"))
    fill = (
        over.where(off < F.col("_gap")).groupBy("source")
        .agg(F.min(F.struct(off.alias("_off"), *PLACE)).alias("_best"))
        .select(F.col("source").alias("_f"),
                F.struct(*[F.col(f"_best.{c}").alias(c) for c in PLACE]).alias("_fill"))
    )
    plan = targets.join(cuts, same("_s"), "left").join(fill, same("_f"), "left")
    plan = plan.select("source", "source_size", "target", "_cut", "_last", "_fill")
    return stage(plan, "mix-plan"), repeats


def chosen() -> Column:
    """Before the limit: in an earlier bucket, or up to the last rank in the limit's own."""
    inside = (F.col("_bucket") == F.col("_cut")) & F.col("_last").isNotNull()
    before = F.col("_bucket") < F.col("_cut")
    return F.coalesce(before | (inside & (F.struct(*PLACE) <= F.col("_last"))), F.lit(False))


def mixed(docs: DataFrame, plan: DataFrame, repeats: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target and copies."""
    own = docs.columns
    sized = numbered(docs.withColumn("_hash", text_name()), repeats).withColumn("size", words())
    rows = ranked(sized, plan.select("source", "source_size", "target"), seed)
    limits = plan.select(F.col("source").alias("_s"), "_cut", "_last", "_fill")
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("_s")))
    fills = F.coalesce(F.struct(*PLACE) == F.col("_fill"), F.lit(False))
    # A source whose whole sample is needed has no limit: every fraction is taken.
    all_taken = F.col("_rank").isNotNull() & F.col("_cut").isNull()
    extra = (chosen() | fills | all_taken).cast("int")
    return joined.select(
        *own, "size", "source_size", "target",
        (F.col("_whole") + extra).cast("int").alias("copies"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "source", "text")
    return mixed(narrow, *mixing_plan(narrow)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix_corpus(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: a row per copy taken, with the columns of `docs`."""
    inner = {c: c if c in ("doc_id", "source", "text") else f"_in_{at}"
             for at, c in enumerate(docs.columns)}
    renamed = docs.select(*[quoted(c).alias(name) for c, name in inner.items()])
    rows = mixed(renamed, *mixing_plan(docs.select("doc_id", "source", "text"))).where("copies > 0")
    copied = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_turn"))
    return copied.select(*[F.col(name).alias(c) for c, name in inner.items()])
