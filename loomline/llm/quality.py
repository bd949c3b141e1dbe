"""Document quality by votes of the nearest labelled documents in a latent space.

A text is counted by words and by word shapes (`THE!!` and `of***` have shapes of
their own; so have repeated words and repeated lines), hashed to a fixed width, damped
and weighted by rarity. Latent-semantic vectors are the leading singular directions of
the labelled texts. At most `max_labelled` labelled vectors of `LATENT` numbers are
broadcast: a fixed bound, however large the corpus. Every document is compared with
every labelled one by exact cosine products, a block of documents at a time; the
`NEIGHBOURS` nearest vote with weights that grow with their similarity. Vectors are
rounded to whole multiples of 2^-`BITS`, so products and sums are whole numbers that a
double holds: they do not depend on the block or on the order of addition.

Null and empty texts have a term of their own, so they are compared like any other.
A text similar to none gets the share of label 1 among the labelled; without labelled
rows that is 0.5. Equal texts get equal scores. Ties in similarity go to the labelled
text that comes first by hash, of equal texts to label 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomline.llm.labelled import held_out, training_texts

SHAPES = 512
WORDS = 1024
WIDTH = SHAPES + WORDS
WORD_WEIGHT = 0.3
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 8
BITS = 20  # of a whole vector: sums of its products stay below 2^53
BLOCK = 256
CACHE = 1 << 17
RUN = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """Letters by case, digits as 0, other signs as they are; runs count once."""
    signs = "".join(
        ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c for c in token
    )
    return RUN.sub(r"\1", signs)


class Places(dict):
    """Hashed columns of a token: its shape's and its word's, found once per token."""

    def __missing__(self, token: str) -> tuple[int, int]:
        word = "".join(c for c in token.lower() if c.isalnum())
        value = (zlib.crc32(shape(token).encode("utf-8", "replace")) % SHAPES,
                 SHAPES + zlib.crc32(word.encode("utf-8", "replace")) % WORDS)
        if len(self) < CACHE:
            self[token] = value
        return value


def mark(name: str) -> int:
    return zlib.crc32(name.encode()) % SHAPES


def counts(text: str | None, places: Places) -> np.ndarray:
    """Damped term counts of a text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    tokens = (text or "").split()
    if not tokens:
        out[mark("\x00empty")] = 1
        return out
    for token, n in Counter(tokens).items():
        a, b = places[token]
        out[a] += n
        out[b] += n
    repeats = sum(map(str.__eq__, tokens, tokens[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    out[mark("\x00repeat")] += 4 * repeats
    out[mark("\x00line")] += 4 * (len(lines) - len(set(lines)))
    out[mark(f"\x00size{int(math.log2(len(tokens)))}")] += 1
    out[:SHAPES] /= len(tokens)
    np.sqrt(out[:SHAPES], out=out[:SHAPES])
    np.log1p(out[SHAPES:], out=out[SHAPES:])
    return out


def packed(row: np.ndarray) -> bytes:
    """Places and values of what is not zero."""
    places = np.nonzero(row)[0]
    return places.astype("<i2").tobytes() + row[places].astype("<f4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    count = len(data) // 6
    out = np.zeros(WIDTH, dtype=np.float32)
    out[np.frombuffer(data, "<i2", count)] = np.frombuffer(data, "<f4", count, 2 * count)
    return out


@dataclass
class Model:
    weights: np.ndarray  # rarity of terms
    axes: np.ndarray  # WIDTH x LATENT, whole
    vectors: np.ndarray  # labelled documents, unit length, whole
    labels: np.ndarray
    share: float


def weighted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shapes and words each scaled to a length of their own."""
    out = rows * weights
    for part, size in ((slice(0, SHAPES), 1.0), (slice(SHAPES, WIDTH), WORD_WEIGHT)):
        norm = np.linalg.norm(out[:, part], axis=1, keepdims=True)
        out[:, part] *= size / np.maximum(norm, 1e-9)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def whole(rows: np.ndarray) -> np.ndarray:
    """Multiples of 2^-BITS as whole numbers in doubles."""
    return np.rint(rows.astype(np.float64) * (1 << BITS))


def latent(rows: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of counted texts, whole."""
    return whole(unit(whole(weighted(rows, weights)) @ axes))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        max_labelled: int = 6000) -> Model | None:
    texts = training_texts(docs, labels, label, max_labelled)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places()
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at:at + BLOCK]
                yield pd.DataFrame({"key": part["key"], "label": part["label"],
                                    "x": [packed(counts(text, places)) for text in part["text"]]})

    keyed = texts.select(F.xxhash64("text").alias("key"), "label", "text")
    rows = keyed.mapInPandas(counted, "key long, label int, x binary").toPandas()
    if rows.empty:  # at most max_labelled rows of WIDTH numbers
        return None
    rows = rows.sort_values(["key", "label"], kind="stable")
    matrix = np.stack([unpacked(data) for data in rows["x"]])
    known = rows["label"].to_numpy().astype(np.float32)
    weights = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 0.1
    scaled = weighted(matrix, weights)
    values, vectors = np.linalg.eigh((scaled.T @ scaled).astype(np.float64))
    axes = whole(vectors[:, np.argsort(values)[::-1][:LATENT]])
    del scaled
    known_vectors = [latent(matrix[at:at + BLOCK], weights, axes)
                     for at in range(0, len(matrix), BLOCK)]
    return Model(weights, axes, np.concatenate(known_vectors), known, float(known.mean()))


def votes(rows: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    products = latent(rows, model.weights, model.axes) @ model.vectors.T
    count = products.shape[1]
    k = min(NEIGHBOURS, count)
    # One number orders by product and then by place, so no two are equal.
    order = products.astype(np.int64) * -count + np.arange(count)
    nearest = np.sort(np.argpartition(order, k - 1, axis=1)[:, :k], axis=1)
    near = np.maximum(np.take_along_axis(products, nearest, axis=1), 0.0) / (1 << 2 * BITS)
    weight = near ** SHARPNESS
    total = weight.sum(axis=1)
    vote = (weight * model.labels[nearest]).sum(axis=1)
    return np.where(total > 1e-12, vote / np.maximum(total, 1e-12), model.share)


def scorer(model: Model | None):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(0.5, index=texts.index)
        places, out = Places(), []
        for at in range(0, len(texts), BLOCK):
            rows = np.stack([counts(text, places) for text in texts.iloc[at:at + BLOCK]])
            out.append(votes(rows, model))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """All columns of `docs` with `__quality_result`, the share of label 1 around the text."""
    return docs.withColumn("__quality_result", scorer(fit(docs, labels, label))(F.col("text")))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored(docs.select("doc_id", "text"), labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__quality_result").alias("score"),
        (F.col("__quality_result") >= threshold).cast("int").alias("predicted"),
    )
