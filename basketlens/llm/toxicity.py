"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words, of their beginnings of 3 to 7 bytes (many languages compound), of pairs of
neighbouring words and of pairs with one word between, in 2^22 coordinates, each with the logarithm of one plus its count;
words are runs of letters, digits and non-ASCII bytes, lower-cased. Training keeps a rate per coordinate and an L1 term, so that
few coordinates have a weight and the model is a short list that is sent with the scoring tasks. It is fitted on a bounded
sample of labelled rows, chosen by a hash of doc_id (`sample`); every document is scored on its whole text.

A null or empty text has no features and gets the bias. Labels without doc_id or value are ignored, of several labels of a
document the largest holds. Without examples of both labels, or if no feature earns a weight, nothing is learned: every score is
that of the bias UNKNOWN, under 0.5, so that no document is rejected. Extra columns and repeated rows change nothing.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketlens.llm.common import table, tell_workers
from basketlens.llm.words import mixed

BITS = 22
#: At most so many labelled documents are learned from, in so many passes; coordinates in fewer documents than RARE are left out.
SAMPLE, EPOCHS, RARE = 6_000, 4, 3
#: FTRL-proximal: rate, its smoothing, L1 and L2; and how often an example of label 1 counts.
ALPHA, BETA, L1, L2, POSITIVE = 0.3, 1.0, 6.0, 0.1, 3.0
BEGINNINGS = (3, 4, 5, 6, 7)
#: The bias of a model that could learn nothing.
UNKNOWN = -1.0
#: A-Z to a-z, other ASCII but a-z and 0-9 to a space.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
SHIFT, ODD = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker keeps from text to text.
CACHE = 80_000


class Model(NamedTuple):
    bias: float
    index: np.ndarray
    weight: np.ndarray


class Words(dict):
    """Words to the row of `hashes` that holds their own hash and those of their beginnings, 0 where a word is no longer."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((CACHE, 1 + len(BEGINNINGS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        if row == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[row, 0] = xxhash.xxh3_64_intdigest(word)
        for j, k in enumerate(BEGINNINGS, 1):
            self.hashes[row, j] = xxhash.xxh3_64_intdigest(word[:k], seed=k) if len(word) > k else 0
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[rows]


WORDS = Words()


def features(text: bytes) -> np.ndarray:
    """Coordinates of a text's words, their beginnings, pairs and skipping pairs, as often as they occur."""
    words = text.translate(CLEAN).split()
    if not words:
        return np.empty(0, np.uint32)
    h = WORDS.of(words)
    w = h[:, 0]
    parts = h[h != 0]
    pairs = mixed(w[:-1] * ODD + w[1:])
    skips = mixed((w[:-2] ^ ODD) * ODD + w[2:])
    return (np.concatenate([parts, pairs, skips]) >> SHIFT).astype(np.uint32)


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rare: int = RARE) -> Model:
    """Passes over (label, distinct coordinates, counts), example by example; place 0 of the state is the bias."""
    if len({y for y, _, _ in examples}) < 2:
        return Model(UNKNOWN, np.empty(0, np.uint32), np.empty(0))
    common = np.zeros(1 << BITS, np.int32)
    for _, found, _ in examples:
        common[found] += 1
    common = common >= rare
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(epochs):
        for y, found, counts in examples:
            use = common[found]
            i = np.concatenate([[0], found[use].astype(np.int64) + 1])
            x = np.concatenate([[1.0], np.log1p(counts[use])])
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = _weights(zi, root)
            w[0] = -zi[0] / ((BETA + root[0]) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * (POSITIVE if y else 1.0)
            rate = (np.sqrt(ni + g * g) - root) / ALPHA
            z[i] = zi + g - rate * w
            n[i] = ni + g * g
    w = _weights(z, np.sqrt(n))
    used = np.flatnonzero(w[1:])
    if not len(used):  # too few examples for any weight: their share of toxic ones says nothing of other texts
        return Model(UNKNOWN, np.empty(0, np.uint32), np.empty(0))
    bias = float(-z[0] / ((BETA + np.sqrt(n[0])) / ALPHA))
    return Model(bias, used.astype(np.uint32), w[1:][used])


def _weights(z: np.ndarray, root: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + root) / ALPHA + L2))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on `sample` labelled documents at most, none of them held out. The sample's features meet in one task, whose work
    that bound limits; the model, a few thousand weights, comes to the driver."""
    tell_workers(docs.sparkSession)
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        .select(F.col("doc_id").alias("id"), "y", F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "id")

    def extract(batches):
        for batch in batches:
            found = [np.unique(features(t), return_counts=True) for t in batch["text"]]
            found = [np.concatenate([i, c.astype(np.uint32)]).tobytes() for i, c in found]
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "y": batch["y"], "found": found})

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "id", "found"]).drop_duplicates(["h", "id"])  # of different texts of an id, the least features
        model = fit([(y, *np.frombuffer(x, np.uint32).reshape(2, -1)) for y, x in zip(part["y"], part["found"])])
        return pd.DataFrame({"bias": [model.bias], "i": [model.index.tobytes()], "w": [model.weight.tobytes()]})

    examples = rows.mapInPandas(extract, "id long, h long, y int, found binary")
    fitted = examples.groupBy().applyInPandas(train, "bias double, i binary, w binary").first()
    if fitted is None:
        return Model(UNKNOWN, np.empty(0, np.uint32), np.empty(0))
    return Model(fitted["bias"], np.frombuffer(fitted["i"], np.uint32), np.frombuffer(fitted["w"]))


def scorer(model: Model):
    """A column function: text to the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.index] = model.weight
        for texts in batches:
            out = np.empty(len(texts))
            for k, text in enumerate(texts):
                i = features(text)
                i, counts = np.unique(i[dense[i] != 0], return_counts=True)
                out[k] = model.bias + dense[i] @ np.log1p(counts)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return lambda text: score(F.coalesce(text, F.lit("")).cast("binary"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under the limit."""
    return docs.where(scorer(learn(docs, labels))(F.col("text")) < limit)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    score = scorer(learn(docs, table(spark, folder, "labels")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
