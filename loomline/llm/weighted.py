"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are shingles of `SHINGLE` words with their counts as weights S. In every round j
a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its own hash; with
t = floor(ln S / r + b) it is ranked by ln a = ln c - r (t - b + 1). The sample is the
term of least a with its t: two texts draw the same one with the probability that
equals their generalised Jaccard similarity, sum of minima over sum of maxima.

Each of the `ROUNDS` samples is drawn over all terms of the text, whatever their number;
the likeness is the share of equal samples.

Weights are counted inside the row, so terms are exploded but never shuffled: the least
ranks are primitive minima, taken where the text already is. A term that a text and its
edited form both hold once is drawn for both at a time. The least a of a text of n
shingles is exponential with mean 1 / n, so draws that are surely above `REACH` / n are
left before their logarithms. Where the least a found is above it too, which has a chance
of exp(-REACH), one in 160,000, the sample is drawn again over all terms: the result
is that of all draws. Texts are unique by id and hash before they meet their successors.
Next documents come from positions numbered by range partitions; a document is sent its
successor's first characters only.

Null texts are empty. Texts without words have an empty fingerprint, alike to another
empty one only. Documents are ordered by doc_id, null first, then by a hash of the text;
rows equal in both are one document with equal results. A lone document succeeds itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.tables import full_text
from loomline.operators.ordinals import number_rows
from loomline.staging import stage

SHINGLE = 5
ROUNDS = 64
REACH = 12.0
NEAR = REACH * (1 + 1e-9)  # what rounding could leave out is kept
DIGITS = 4
EMPTY = "." * DIGITS
SPACE = r"[\x20\x09-\x0D]+"
KEY = ["id_key", "text_hash"]
NO_ID = -(1 << 63)  # stands for a null doc_id, so that keys join by plain equality
OWN, EDITED, DIGEST, BOTH = 0, 1, 2, 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Sorted hashes of shingles of a column of words, repeats included; a short text is one."""
    count = F.least(F.size(words), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    zipped = F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i}") for i in range(size)])
    return F.sort_array(F.transform(
        zipped, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(size)])))


def last_places(hashes: Column) -> Column:
    """The last place of every run of equal values in a sorted array."""
    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1))
    return F.coalesce(
        F.filter(places, lambda i: ~F.get(hashes, i).eqNullSafe(F.get(hashes, i + 1))),
        F.array().cast("array<int>"))


def repeats(hashes: Column, wanted: bool) -> Column:
    """Of a sorted array, the values that stand in it more than once, or those that do not."""
    def again(x: Column, i: Column) -> Column:
        twice = x.eqNullSafe(F.get(hashes, i - 1)) | x.eqNullSafe(F.get(hashes, i + 1))
        return twice if wanted else ~twice

    return F.filter(hashes, again)


def single_terms(hashes: Column, side: int) -> Column:
    return F.transform(hashes, lambda x: F.struct(
        F.lit(side).alias("side"), x.alias("term"), F.lit(1).alias("weight")))


def weighted_terms(hashes: Column, ends: Column, side: int) -> Column:
    """Structs (side, term, weight) from sorted hashes and the ends of their runs."""
    return F.transform(ends, lambda end, i: F.struct(
        F.lit(side).alias("side"), F.get(hashes, end).alias("term"),
        (end - F.coalesce(F.get(ends, i - 1), F.lit(-1))).alias("weight")))


def digest_parts(text: Column) -> Column:
    """A text's SHA-256 as four whole numbers, in the shape of terms."""
    digest = F.sha2(text, 256)
    return F.array(*[
        F.struct(F.lit(DIGEST).alias("side"),
                 F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias("term"),
                 F.lit(i).alias("weight")) for i in range(4)])


def uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def gammas() -> tuple[Column, Column, Column]:
    """exp(-r), exp(-c) and b of a term in a round, from its two hashes."""
    one, two = F.xxhash64("term", "_round"), F.xxhash64("_round", "term")
    return (uniform(one, 0, 30) * uniform(one, 30, 30),
            uniform(two, 0, 24) * uniform(two, 24, 24), uniform(two, 48, 16))


def scaled(rank: Column) -> Column:
    """ln a as a whole number of 31 bits, in order."""
    return F.least(F.greatest((rank + 64.0) * float(1 << 23), F.lit(0.0)), F.lit(2.0 ** 30)).cast("long")


def least_samples(terms: DataFrame) -> DataFrame:
    """Per text and side the least sample of every round and `total`, and the digest's parts.

    `total` is at most the sum of the weights of any side that holds the term. Where the
    terms have `rounds`, only these are drawn, and all their draws are kept.
    """
    digest = F.col("side") == DIGEST
    some, bounded = "rounds" in terms.columns, "total" in terms.columns
    terms = terms if bounded else terms.withColumn("total", F.lit(1))
    every = F.col("rounds") if some else F.array(*[F.lit(i) for i in range(ROUNDS)])
    rounds = terms.select(*KEY, "side", "term", "weight", "total", F.explode(
        F.when(digest, F.array("weight")).otherwise(every)).alias("_round"))
    r_exp, c_exp, b = gammas()
    if bounded and not some:
        # a >= c exp(-r) / S and c >= 1 - exp(-c). What passes is held against nearer bounds: for
        # S = 1, a = c exp(-r (1 - b)), a geometric mean, which is at least the harmonic one; and
        # c >= 2 (1 - exp(-c)) / (1 + exp(-c)).
        least = r_exp * (1 - c_exp) * F.col("total")
        most = F.when(F.col("weight") == 1, 1 - b * (1 - r_exp)).otherwise(F.col("weight"))
        rounds = rounds.where(digest | (
            (least <= NEAR * F.col("weight")) & (2 * least <= NEAR * (1 + c_exp) * most)))
    drawn = rounds.withColumns({"_r": -F.log(r_exp), "_c": F.log(-F.log(c_exp)), "_b": b})
    timed = drawn.withColumn("_t", F.floor(F.log("weight") / F.col("_r") + F.col("_b")))
    rank = F.col("_c") - F.col("_r") * (F.col("_t") - F.col("_b") + 1)
    sample = F.xxhash64("term", "_t", "_round").bitwiseAND(F.lit(0xFFFFFFFF))
    ranked = timed.select(*KEY, "side", "term", "_round", "total",
                          F.shiftleft(scaled(rank), 32).bitwiseOR(sample).alias("v"))
    of = lambda side: F.min(F.when(F.col("side").isin(side, BOTH), F.col("v")))
    found = ranked.groupBy(*KEY, "_round").agg(
        of(OWN).alias("own"), of(EDITED).alias("edited"),
        F.max(F.when(digest, F.col("term"))).alias("part"), F.max("total").alias("total"))
    sides = found.select(*KEY, "_round", "total", F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(name).alias("v"))
        for side, name in ((OWN, "own"), (EDITED, "edited"), (DIGEST, "part"))]))).where("v IS NOT NULL")
    at = lambda i: F.max(F.when(F.col("_round") == i, F.col("v")))
    return sides.groupBy(*KEY, "side").agg(
        F.max("total").alias("total"), *[at(i).alias(f"m{i}") for i in range(ROUNDS)])


def keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id_key"),
            F.xxhash64(full_text()).alias("text_hash")]


def successors(docs: DataFrame) -> DataFrame:
    """Each document with the characters it takes from the next, and its predecessor's key."""
    keyed = docs.select(
        "doc_id", *keys(), F.char_length(full_text()).cast("long").alias("n_chars"),
    ).groupBy("doc_id", *KEY, "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    at = stage(number_rows(stage(keyed, "document-keys"), order, column="at", start=0), "order")
    total = at.count()
    before = at.select(
        F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("at"), F.col("id_key").alias("prev_id"),
        F.col("text_hash").alias("prev_hash"), F.floor(F.col("n_chars") / 4).alias("prev_take"))
    after = at.select(
        F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"), F.col("id_key").alias("next_id"),
        F.col("text_hash").alias("next_hash"))
    return stage(at.join(before, "at").join(after, "at").drop("at"), "successors")


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(id_key, text_hash, text, edited): the last quarter gives way to the next one's start.

    Texts stay dealt by their key from here to their samples, so they cross the network once.
    """
    named = order.select(*KEY, F.floor(F.col("n_chars") / 4).cast("int").alias("take"), "n_chars",
                         "prev_id", "prev_hash", F.col("prev_take").cast("int").alias("prev_take"))
    met = docs.select(*keys(), full_text().alias("text")).dropDuplicates(KEY).join(named, KEY)
    starts = met.select(
        F.col("prev_id").alias("id_key"), F.col("prev_hash").alias("text_hash"),
        F.substring("text", F.lit(1), F.col("prev_take")).alias("start"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.col("take")).cast("int"))
    return met.join(starts, KEY).select(*KEY, "text", F.concat(kept, "start").alias("edited"))


def listed_terms(texts: DataFrame) -> DataFrame:
    """(id_key, text_hash, total, side, term, weight) of own and edited texts, and digest parts."""
    cut = texts.select(
        *KEY, *[c for c in texts.columns if c == "rounds"],
        digest_parts(F.col("edited")).alias("digest"),
        words_of(F.col("text")).alias("own"), words_of(F.col("edited")).alias("new"))
    kept = [c for c in cut.columns if c not in ("own", "new")]
    hashed = cut.select(*kept, shingle_hashes(F.col("own")).alias("own"),
                        shingle_hashes(F.col("new")).alias("new"))
    parted = hashed.select(
        *kept,
        F.least(*[F.greatest(F.size(x), F.lit(1)) for x in ("own", "new")]).alias("total"),
        *[repeats(F.col(x), wanted).alias(f"{x}_{name}") for x in ("own", "new")
          for name, wanted in (("more", True), ("once", False))])
    ended = parted.withColumns({"own_ends": last_places(F.col("own_more")),
                                "new_ends": last_places(F.col("new_more"))})
    listed = F.concat(
        single_terms(F.array_intersect("own_once", "new_once"), BOTH),
        single_terms(F.array_except("own_once", "new_once"), OWN),
        single_terms(F.array_except("new_once", "own_once"), EDITED),
        weighted_terms(F.col("own_more"), F.col("own_ends"), OWN),
        weighted_terms(F.col("new_more"), F.col("new_ends"), EDITED), "digest")
    return ended.select(*[c for c in kept if c != "digest"], "total", F.inline(listed))


def short(sample: Column) -> Column:
    return sample.bitwiseAND(F.lit((1 << (4 * DIGITS)) - 1)).cast("int")


def signatures(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Samples of own and edited texts and the edited text's digest, per document and side."""
    values = F.array(*[F.col(f"m{i}") for i in range(ROUNDS)])
    digest = F.when(F.col("side") == DIGEST, F.lower(F.concat(*[
        F.lpad(F.hex(f"m{i}"), 16, "0") for i in range(4)])))
    reached = scaled(F.log(REACH / F.col("total")))
    open_rounds = F.filter(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda i: F.coalesce(
        F.shiftright(F.get(F.col("values"), i), 32) >= F.col("reached"), F.lit(True)))
    first = stage(
        least_samples(listed_terms(edited_texts(docs, order)))
        .select(*KEY, "side", values.alias("values"), digest.alias("digest"), reached.alias("reached"))
        .select(*KEY, "side", F.transform("values", short).alias("samples"), "digest",
                F.when(F.col("side") != DIGEST, open_rounds).alias("open")), "signatures")
    # The few samples whose least rank is not below what was left out are drawn over all terms.
    asked = stage(
        first.where(F.size("open") > 0).select(*KEY, F.explode("open").alias("round"))
        .groupBy(*KEY).agg(F.collect_set("round").alias("rounds")), "open-samples")
    needed = stage(
        asked.join(order, KEY).select(F.inline(F.array(
            F.struct(*[F.col(c).alias(f"_{c}") for c in KEY]),
            F.struct(F.col("next_id").alias("_id_key"), F.col("next_hash").alias("_text_hash")))))
        .distinct(), "open-texts")
    found = [own == F.col(f"_{c}") for own, c in zip(keys(), KEY)]
    texts = edited_texts(docs.join(needed, found[0] & found[1], "left_semi"), order)
    again = least_samples(listed_terms(texts.join(asked, KEY))).where(F.col("side") != DIGEST)
    drawn = stage(again.select(*KEY, "side", F.transform(values, short).alias("drawn")), "drawn-again")
    mended = first.join(drawn, [*KEY, "side"], "left")
    samples = F.when(F.col("drawn").isNull(), F.col("samples")).otherwise(F.transform(
        "samples", lambda x, i: F.coalesce(F.get(F.col("drawn"), i), x)))
    return mended.select(*KEY, "side", samples.alias("samples"), "digest")


def printed(samples: Column) -> Column:
    none = F.array_repeat(F.lit(None).cast("int"), ROUNDS)
    return F.array_join(F.transform(F.coalesce(samples, none), lambda x: F.coalesce(
        F.lower(F.lpad(F.hex(x), DIGITS, "0")), F.lit(EMPTY))), "")


def likeness(one: Column, two: Column) -> Column:
    """Share of equal samples; 1 for two empty texts, 0 for an empty one and another."""
    none = F.array_repeat(F.lit(None).cast("int"), ROUNDS)
    pairs = F.arrays_zip(F.coalesce(one, none).alias("a"), F.coalesce(two, none).alias("b"))
    filled = F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    equal = F.filter(filled, lambda x: x["a"] == x["b"])
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(F.size(equal) / F.size(filled))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    order = successors(docs)
    signed = signatures(docs.select("doc_id", "text"), order)
    side = lambda which, name: signed.where(F.col("side") == which).select(
        *KEY, F.col("digest" if which == DIGEST else "samples").alias(name))
    after = side(OWN, "after").withColumnsRenamed({"id_key": "next_id", "text_hash": "next_hash"})
    joined = (
        order.join(side(OWN, "own"), KEY, "left").join(side(EDITED, "edited"), KEY, "left")
        .join(side(DIGEST, "sha"), KEY, "left").join(after, ["next_id", "next_hash"], "left")
    )
    rows = joined.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"), "copies",
    )
    every = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c"))
    return every.drop("copies", "_c")
