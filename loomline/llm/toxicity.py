"""Toxic passages as maximum-scoring segments of token log-odds.

Terms are whole words and word beginnings. A term's score is the log-odds of toxic
against other documents, each class smoothed by a Dirichlet prior that follows the
pooled counts, so a term seen once says little. Words count by documents; beginnings
count by distinct words, so one frequent word does not speak for all that start alike,
and are in turn the prior of the words below them. Only significant terms are kept; every other token has one small negative score.

A linear scan (all maximal scoring subsequences) finds every passage of a text whose
score rises above its surroundings; every occurrence of a term scores in it. What a passage
counts for is the best of its windows, in which each word scores once, where it last
occurs, and its repeats score nothing. Passages are judged by extreme-value statistics:
by chance a text of n tokens has K n exp(-lambda S) passages of score S or more.
Lambda solves sum p exp(lambda s) = 1 over the scores of clean training tokens, K is
fitted on clean training texts. A document's evidence is the sum of ln(1 / E) over its
significant passages (E < 1), or that of its best one where there is none; a logistic
curve fitted on the training texts turns it into a score between 0 and 1.

Learning takes at most `max_labelled` labelled rows, chosen by hash, and at most
`max_terms` terms: the bounds of what is broadcast. Scoring reads every whole text.
Null and empty texts have no tokens and the lowest evidence of all. Labels that are
null are not used; a document labelled twice is toxic if one label says so. Without
training rows every score is 0.5 less a margin, so nothing is predicted toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomline.llm.labelled import held_out, training_texts
from loomline.llm.tables import free_name, quoted
from loomline.staging import stage

WORD = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
PRIOR = 5.0
LEAST_Z = 4.0
LEAST_LOG_ODDS = 1.5
CACHE = 1 << 18


@dataclass
class Model:
    terms: dict[str, float]
    rest: float
    slope: float = 1.0
    log_k: float = 0.0
    bias: float = -1.0
    weight: float = 0.0


class Scores(dict):
    """Scores of words, looked up once each: the word itself, else its longest known beginning."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        found = self.terms.get(word)
        for size in STEMS:
            if found is not None:
                break
            if len(word) > size:
                found = self.terms.get(word[:size] + "*")
        value = max(found, 0.0) if found is not None else 0.0
        if len(self) < CACHE:
            self[word] = value
        return value


def passages(scored: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring runs of tokens as (first, last, score), in one linear scan.

    `scored` holds the positive tokens as (position, score); all others score `rest` < 0.
    Each run on the stack keeps the running total before it (`left`) and at its end (`right`).
    """
    stack: list[list] = []  # first, last, left, right, index of the nearest run with lower left
    total, at = 0.0, -1
    for position, score in scored:
        left = total + rest * (position - at - 1)
        total, at = left + score, position
        run = [position, position, left, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= run[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= run[3]:
                run[4] = j
                stack.append(run)
                break
            run = [stack[j][0], run[1], stack[j][2], run[3], -1]
            del stack[j:]
    return [(first, last, right - left) for first, last, left, right, _ in stack]


def lowered(text: str | None) -> list[str]:
    """The words of a text, each in lower case, so that their places are those of the text."""
    return list(map(str.lower, WORD.findall(text or "")))


def scan(text: str | None, scores: Scores, rest: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the passages as token positions."""
    words = lowered(text)
    values = list(map(scores.__getitem__, words))
    return len(words), damped(words, values, rest)


def damped(words: list[str], values: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All passages over every scoring token, each with the score of its best window."""
    hits = [(i, value) for i, value in enumerate(values) if value > 0.0]
    out, at = [], 0
    for first, last, score in passages(hits, rest) if hits else []:
        while hits[at][0] < first:
            at += 1
        start = at
        while at < len(hits) and hits[at][0] <= last:
            at += 1
        inside = hits[start:at]
        if len({words[i] for i, _ in inside}) < len(inside):
            score = best_window(words, inside, rest)
        out.append((first, last, score))
    return out


def best_window(words: list[str], hits: list[tuple[int, float]], rest: float) -> float:
    """The largest score of a window of tokens in which each word scores once.

    What a window is worth depends on the hit it starts at. A hit adds its score to every
    start after the last use of its word. That never sets an earlier start above a later one
    again, so starts that a later one has come up to are dropped, once each. The rest lie in
    falling order, linked, each with its lead over the next; an added score shortens one lead.
    """
    before: list[int] = []  # the next earlier start that is left
    lead: list[float] = []  # of that start over this one
    later: list[int] = []  # itself while it is left, else one that has come up to it
    used: dict[str, int] = {}
    best, top, last = 0.0, 0.0, 0.0  # values of the first and of the latest start left

    def left(start: int) -> int:
        while later[start] != start:
            later[start] = later[later[start]]
            start = later[start]
        return start

    def settle(start: int) -> None:
        """Drop the starts before this one that it has come up to."""
        nonlocal top
        while before[start] >= 0 and lead[start] <= 0:
            gone = before[start]
            later[gone] = start
            before[start] = before[gone]
            if before[start] < 0:
                top -= lead[start]
            else:
                lead[start] += lead[gone]

    for n, (position, score) in enumerate(hits):
        neutral = position - n
        value = -rest * neutral
        before.append(n - 1 if n else -1)
        lead.append(last - value)
        later.append(n)
        if not n:
            top = value
        settle(n)
        first = left(used.get(words[position], -1) + 1)
        if before[first] < 0:
            top += score
        else:
            lead[first] -= score
            settle(first)
        last = value + score
        used[words[position]] = n
        best = max(best, top + rest * neutral)
    return best


def evidence(tokens: int, found: list[tuple[int, int, float]], model: Model) -> float:
    base = model.log_k + math.log(max(tokens, 1))
    if not found:
        return -max(base, 0.0)
    logs = [model.slope * score - base for _, _, score in found]
    significant = sum(value for value in logs if value > 0)
    return significant if significant else max(max(logs), -max(base, 0.0))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for label, texts in batch.groupby("label")["text"]:
            counts: Counter[str] = Counter()
            for text in texts:
                counts.update(set(lowered(text)))
            yield pd.DataFrame({"term": pd.Series(list(counts), dtype=object),
                                "label": int(label), "n": list(counts.values())})


def log_odds(terms: DataFrame, ones: str, zeros: str, total: dict[str, float]) -> DataFrame:
    """Add log_odds and z; each class's prior is its share of `PRIOR` pseudo-counts."""
    share = total["ones"] / (total["ones"] + total["zeros"])
    one = F.col(ones) + PRIOR * share
    zero = F.col(zeros) + PRIOR * (1 - share)
    value = F.log(one / zero) - math.log(share / (1 - share))
    return terms.withColumn("log_odds", value).withColumn("z", value / F.sqrt(1 / one + 1 / zero))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 20_000,
        max_terms: int = 20_000) -> Model:
    texts = training_texts(docs, labels, label, max_labelled)
    sizes = {row["label"]: row["count"] for row in texts.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, -0.1)
    spread = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism)
    counted = spread.mapInPandas(_count_words, "term string, label int, n long")
    by_label = lambda value: F.sum(F.when(F.col("label") == value, F.col("n")).otherwise(0))
    words = stage(
        counted.groupBy("term").agg(by_label(1).alias("ones"), by_label(0).alias("zeros")), "words"
    )
    total = words.agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"),
        F.sum(F.least("ones", F.lit(1))).alias("types"),
        F.sum(F.least("zeros", F.lit(1))).alias("other_types"),
    ).first().asDict()
    if not total["ones"] or not total["zeros"]:
        return Model({}, -0.1)
    def starts(size: int) -> Column:
        return F.when(F.length("term") > size,
                      F.concat(F.substring("term", 1, size), F.lit("*")))

    stems = (
        words.select(F.explode(F.array_compact(F.array(*[starts(size) for size in STEMS])))
                     .alias("term"),
                     F.least("ones", F.lit(1)).alias("ones"),
                     F.least("zeros", F.lit(1)).alias("zeros"))
        .groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    )
    types = {"ones": total["types"], "zeros": total["other_types"]}
    strong = (F.col("z") >= LEAST_Z) & (F.col("log_odds") >= LEAST_LOG_ODDS)
    best = [F.col("z").desc(), F.col("term")]
    kept = stage(
        log_odds(stems, "ones", "zeros", types).where(strong).orderBy(*best).limit(max_terms),
        "stems",
    )
    terms = {row["term"]: row["log_odds"] for row in kept.collect()}
    for row in (log_odds(words, "ones", "zeros", total).where(strong).orderBy(*best)
                .limit(max_terms).collect()):
        terms[row["term"]] = row["log_odds"]
    # Under a kept beginning, a word's prior is what its beginning says.
    begun = (
        words.select("term", "ones", "zeros", F.inline(F.array(*[
            F.struct(F.lit(size).alias("size"), starts(size).alias("stem")) for size in STEMS])))
        .join(F.broadcast(kept.select(F.col("term").alias("stem"),
                                      F.col("log_odds").alias("prior"))), "stem")
        .groupBy("term", "ones", "zeros").agg(F.max_by("prior", "size").alias("prior"))
    )
    shift = math.log(total["ones"] / total["zeros"])
    chance = 1 / (1 + F.exp(-(F.col("prior") + shift)))
    own = F.log((F.col("ones") + PRIOR * chance) / (F.col("zeros") + PRIOR * (1 - chance))) - shift
    for row in (begun.select("term", own.alias("log_odds"), (F.col("ones") + F.col("zeros"))
                             .alias("n")).orderBy(F.col("n").desc(), "term")
                .limit(max_terms).collect()):
        terms[row["term"]] = max(row["log_odds"], 0.0)
    model = Model(terms, -0.1)
    calibrate(spread, model)
    return model


def solve_slope(counts: Counter, rest: float) -> float:
    """The positive root of sum p exp(slope s) = 1 over clean tokens, rest included."""
    whole = sum(counts.values())
    mean = sum(s * n for s, n in counts.items()) / whole
    if mean >= 0 or max(counts) <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda x: sum(n * math.exp(min(x * s, 500.0)) for s, n in counts.items()) / whole - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def calibrate(texts: DataFrame, model: Model) -> None:
    """Lambda and K from clean training texts, the logistic curve from all of them."""
    terms, rest = model.terms, model.rest

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(terms)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                words = lowered(text)
                values = [scores[word] for word in words]
                found = damped(words, values, rest)
                out.append((int(label), len(words), [p[2] for p in found],
                            [value for value in values if value > 0.0]))
            yield pd.DataFrame(out, columns=["label", "tokens", "runs", "hits"])

    schema = "label int, tokens long, runs array<double>, hits array<double>"
    rows = stage(texts.mapInPandas(scanned, schema), "scanned")
    clean = rows.where("label = 0")
    hits = clean.select(F.explode("hits").alias("s")).groupBy(F.round("s", 1).alias("s")).count()
    counts = Counter({row["s"]: float(row["count"]) for row in hits.collect()})
    tokens = clean.agg(F.sum("tokens").alias("n")).first()["n"] or 1
    for score in {round(value, 1) for value in terms.values() if value > 0}:
        counts[score] += 0.5 / max(1, len(terms))  # no term is impossible in a clean text
    counts[rest] += max(tokens - sum(counts.values()), 1.0)
    model.slope = min(1.0, solve_slope(counts, rest))
    floor = min((v for v in terms.values() if v > 0), default=1.0)
    least = F.lit(floor)
    seen = clean.agg(
        F.sum(F.exists("runs", lambda s: s >= least).cast("int")).alias("hit")
    ).first()["hit"] or 0
    model.log_k = math.log((seen + 0.5) / tokens) + model.slope * floor
    base = F.lit(model.log_k) + F.log(F.greatest("tokens", F.lit(1)))
    logs = F.transform("runs", lambda s: F.lit(model.slope) * s - base)
    strong = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    none = -F.greatest(base, F.lit(0.0))
    weak = F.greatest(F.coalesce(F.array_max(logs), none), none)
    x = F.when(F.size("runs") == 0, none).when(strong > 0, strong).otherwise(weak)
    bins = rows.groupBy(F.round(F.least(x, F.lit(50.0)), 1).alias("x"), "label").count().collect()
    model.bias, model.weight = logistic([(r["x"], r["label"], r["count"]) for r in bins])


def logistic(bins: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and non-negative weight of a logistic curve over counted values (Newton steps)."""
    x = np.array([b[0] for b in bins], dtype=float)
    y = np.array([b[1] for b in bins], dtype=float)
    n = np.array([b[2] for b in bins], dtype=float)
    features = np.stack([np.ones_like(x), x], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (n * (y - p)) - ridge * n.sum() * np.array([0, theta[1]])
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features
        hessian += ridge * n.sum() * np.diag([1e-9, 1.0]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(max(theta[1], 0.0))


RESULT = ("score double, tokens long, "
          "passages array<struct<start:long, end:long, score:double, e_value:double>>")


def scorer(model: Model):
    """A column function: the score of a text and its significant passages (code points)."""
    terms, rest = model.terms, model.rest

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        scores = Scores(terms)
        out = []
        for text in texts:
            text = text or ""
            tokens, found = scan(text, scores, rest)
            logit = model.bias + model.weight * min(evidence(tokens, found, model), 50.0)
            value = 1 / (1 + math.exp(-max(min(logit, 30.0), -30.0)))
            spans = []
            if found:
                places = [m.span() for m in WORD.finditer(text)]
                for first, last, total in found:
                    e = math.exp(min(model.log_k + math.log(tokens) - model.slope * total, 500.0))
                    if e < 1:
                        spans.append({"start": places[first][0], "end": places[last][1],
                                      "score": float(total), "e_value": e})
            out.append((value, tokens, spans))
        return pd.DataFrame(out, columns=["score", "tokens", "passages"])

    return score


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic",
           result: str = "toxic_result") -> DataFrame:
    """All columns of `docs` with a struct `result`: score, tokens, passages."""
    model = fit(docs, labels, label)
    return docs.withColumn(result, scorer(model)(F.col("text")))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), labels)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_result.score").alias("score"),
        (F.col("toxic_result.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_result.passages").alias("n_passages"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    own = [quoted(name) for name in docs.columns]
    result = free_name(docs, "toxic_result")
    rows = scored(docs, labels, result=result)
    return rows.where(F.col(f"{result}.score") < threshold).select(*own)
