"""Secrets in texts: fixed patterns, and strings that a Markov model finds random.

Fixed patterns find assignments, access keys and long hexadecimal runs. Two character
Markov models, blind to case, are trained on labelled samples that the corpus itself gives: values of
fixed-pattern matches are random strings, other words of a sample of documents are
ordinary identifiers. A token of `LONG` characters or more is a secret too if the
log-likelihood ratio of its transitions under the two models exceeds the log of their
frequencies' ratio by `MARGIN`, and is at least `LEAST_MEAN` per transition. Such spans
are added where no fixed match overlaps them; fixed ones stay. Shorter tokens are found by
fixed patterns only. The frequencies are those of long tokens and of long fixed values in
all documents, counted by occurrences: they grow alike, so a larger corpus of the same kind
judges a text alike.

Everything is DataFrame operations. A text is scanned by each pattern once; only texts
with matches are cut at them to get positions, in code points. Matches are narrow rows;
texts are never shuffled. Training takes at most `sample_values` matched values and
`sample_docs` documents, both chosen by hash; the model is a table of at most
42 x 42 ratios.

Null texts are empty. Rows equal in doc_id and text get equal results. Without random
samples the random model is uniform, and the same rule holds.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline.llm.tables import full_text, hash_sample, literal_array
from loomline.staging import stage

# The base patterns, with the group and the length that a match must have.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run is a whole match, so the length may stand in the pattern
KINDS = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]

LONG = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
ALPHABET = LETTERS + "+/_=-"
SIGNS = len(ALPHABET) + 1
MARGIN = 8.0
LEAST_MEAN = 1.5  # per transition, so that length alone makes no secret
UNIFORM = 200.0  # pseudo-transitions per sign: random strings tend to use all signs alike
FLOOR = 0.5  # of a sign in ordinary tokens
BACKOFF = 20.0  # pseudo-transitions of a sign in ordinary tokens
KEY = ["doc_id", "text_hash"]
SPAN = "array<struct<kind:string,rank:int,at:int,gap:int,size:int,value:string,held:int>>"


def cut(text: Column, kind: str, rank: int, pattern: str, group: int) -> Column:
    """Matches with the length of the text between them; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), value.alias("v"),
                          F.split(text, pattern, -1).alias("p"))
    rows = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("at"),
        F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value"),
        F.length(x["v"]).alias("held"),
    ))
    return F.when(text.rlike(pattern), rows.cast(SPAN))


def placed(docs: DataFrame, kinds: list[tuple[str, str, int, int]], first_rank: int) -> DataFrame:
    """Rows (key, kind, rank, start, end, value) of all matches that are long enough."""
    text = F.col("_text")
    keyed = docs.select("doc_id", F.xxhash64(full_text()).alias("text_hash"),
                        full_text().alias("_text"))
    arrays = [cut(text, kind, first_rank + i, pattern, group)
              for i, (kind, pattern, group, _) in enumerate(kinds)]
    rows = keyed.select(*KEY, F.inline(F.flatten(F.array_compact(F.array(*arrays))))).distinct()
    order = Window.partitionBy(*KEY, "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    least = reduce(lambda rest, kind: F.when(F.col("kind") == kind[0], kind[3]).otherwise(rest),
                   kinds, F.lit(0))
    return rows.withColumn("end", end).where(F.col("held") >= least).select(
        *KEY, "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def sign(text: Column, at: Column) -> Column:
    return F.instr(F.lit(ALPHABET), F.lower(F.substring(text, at, F.lit(1))))


def sign_pairs(token: Column) -> Column:
    """Numbers of a token's transitions: previous sign x SIGNS + next sign."""
    places = F.sequence(F.lit(1), F.length(token) - 1)
    return F.transform(places, lambda i: sign(token, i) * SIGNS + sign(token, i + 1))


def transition_ratios(docs: DataFrame, base: DataFrame, sample_docs: int,
                      sample_values: int) -> list[float]:
    """Log-likelihood ratios of transitions, random against ordinary."""
    values = hash_sample(base.select("value").distinct(), F.col("value"), sample_values)
    texts = hash_sample(docs.select("doc_id", full_text().alias("text")),
                        F.struct("doc_id", "text"), sample_docs)
    words = texts.select(
        F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("value")
    ).where(~(F.col("value").rlike(HEX) | F.col("value").rlike(ACCESS)))
    samples = stage(
        values.select("value", F.lit(1).alias("random"))
        .union(words.join(values, "value", "left_anti").select("value", F.lit(0).alias("random"))),
        "secret-samples",
    )
    pairs = samples.where(F.length("value") > 1).select(
        "random", F.explode(sign_pairs(F.col("value"))).alias("pair"))
    counted = pairs.groupBy("random", "pair").count().collect()  # at most 2 x SIGNS x SIGNS rows
    tables = {side: [0.0] * (SIGNS * SIGNS) for side in (0, 1)}
    for row in counted:
        tables[row["random"]][row["pair"]] += row["count"]
    nexts = [sum(tables[0][after::SIGNS]) + FLOOR for after in range(SIGNS)]
    share = [count / sum(nexts) for count in nexts]
    ratios = []
    for before in range(SIGNS):
        rows = {side: tables[side][before * SIGNS:(before + 1) * SIGNS] for side in (0, 1)}
        total = {side: sum(rows[side]) for side in (0, 1)}
        for after in range(SIGNS):
            random = (rows[1][after] + UNIFORM / SIGNS) / (total[1] + UNIFORM)
            # Between letters and digits the prior is how common the next one is at all.
            # Of other signs, which join words, an unseen transition says nothing.
            known = 0 < before <= len(LETTERS) and 0 < after <= len(LETTERS)
            prior = share[after] if known else 1 / SIGNS
            plain = (rows[0][after] + BACKOFF * prior) / (total[0] + BACKOFF)
            ratios.append(math.log(random / plain))
    return ratios


def frequency_odds(tokens: DataFrame, base: DataFrame) -> float:
    """Log of how many times more long tokens than long fixed values all documents hold."""
    random = base.where(F.length("value") >= LONG).count()
    ordinary = max(tokens.count() - random, 0)
    return max(math.log((ordinary + 1) / (random + 1)), 0.0)


def find_secrets(docs: DataFrame, sample_docs: int = 2000,
                 sample_values: int = 20_000) -> DataFrame:
    """Spans (doc_id, text_hash, kind, rank, start, end): fixed ones and random strings."""
    base = stage(placed(docs, KINDS, 0), "fixed-secrets")
    ratios = transition_ratios(docs, base, sample_docs, sample_values)
    table = literal_array([round(ratio, 6) for ratio in ratios], "double")
    likely = F.aggregate(sign_pairs(F.col("value")), F.lit(0.0),
                         lambda total, pair: total + F.element_at(table, pair + 1))
    tokens = stage(placed(docs, [("random", CANDIDATE, 0, LONG)], len(KINDS)), "long-tokens")
    enough = F.greatest(F.lit(frequency_odds(tokens, base) + MARGIN),
                        LEAST_MEAN * (F.length("value") - 1))
    random = tokens.where(likely > enough)
    fixed = base.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"),
                        F.col("start").alias("s"), F.col("end").alias("e"))
    overlap = (
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
        & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    )
    added = stage(random, "random-strings").join(fixed, overlap, "left_anti")
    return base.union(added).drop("value")


def secrets_report(docs: DataFrame) -> DataFrame:
    spans = find_secrets(docs)
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "end", label.alias("label"))))
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    by_doc = spans.groupBy(*KEY).agg(n("assign"), n("access"), n("hex"), listed.alias("spans"))
    joined_labels = lambda keep: F.array_join(
        F.transform(F.filter("spans", keep), lambda x: x["label"]), ",")
    summed = stage(by_doc.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_assign", "n_access", "n_hex",
        joined_labels(lambda x: x["rank"] < len(KINDS)).alias("base"),
        joined_labels(lambda x: F.lit(True)).alias("spans"),
    ), "secret-lists")
    none = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    keyed = docs.select("doc_id", F.xxhash64(full_text()).alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t"))
    return keyed.join(summed, same, "left").select(
        "doc_id", none("n_assign"), none("n_access"), none("n_hex"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
