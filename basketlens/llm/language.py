"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's words are runs of letters, lower-cased. A word's subwords are its stretches of NGRAMS bytes of UTF-8, its ends marked,
and the word as a whole; each is hashed to one of 2^BITS embeddings. A text is the mean of the embeddings of all its subwords,
and a linear softmax gives a probability to every language. Embeddings and softmax are trained by stochastic gradient descent
in numpy, in one task, on a bounded sample: SAMPLE documents, shared equally by the languages and chosen by a hash, each once
as a whole and once as a slice of SLICE words, so that short texts are learned too. A fifth of the sample is set aside: it sets
a temperature (by likelihood) and the least probability at which FAITH of its accepted texts are right; predictions below are
marked as not accepted. The number of languages bounds the model, whatever the corpus holds; every text is read as a whole.

A text that is null or holds no letter is `und` with score 0, and so is every text if no language was learned. A null doc_id
counts as an empty one for the split. Extra columns and repeated rows change nothing; an empty table has an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketlens.llm.common import table, tell_workers
from basketlens.llm.words import mixed

#: Embeddings, their length, and the bytes of a subword.
BITS, WIDTH, NGRAMS = 17, 16, (2, 3, 4)
#: Documents learned from (in all languages together), the words of a slice, passes, and the first rate.
SAMPLE, SLICE, EPOCHS, RATE = 3_000, 12, 4, 0.5
#: Share of accepted texts that are right, by the rows set aside: one of CALIBRATE.
FAITH, CALIBRATE = 0.99, 5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LATIN = re.compile("[A-Za-z]")
SHIFT, ODD = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
#: Words whose embeddings a worker keeps, and words that are looked up together.
CACHE, CHUNK = 60_000, 200_000


class Model(NamedTuple):
    languages: list[str]
    embeddings: np.ndarray  # 2^BITS x WIDTH
    softmax: np.ndarray  # WIDTH + 1 x languages, the last row is the bias
    temperature: float
    threshold: float


def has_letter(text: str) -> bool:
    return LATIN.search(text) is not None or any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the subwords of all words, one word after the other, and how many each has."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(("<" + "><".join(words) + ">").encode(), np.uint8)
    starts = np.flatnonzero(data == ord("<"))  # no word holds the marks
    lengths = np.diff(np.append(starts, len(data)))
    word = np.repeat(np.arange(len(words)), lengths)
    values = data.astype(np.uint64) + np.uint64(1)
    found, owner = [], []
    for n in NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        inside = np.flatnonzero(word[:m] == word[n - 1 :])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + values[inside + k]
        found.append(mixed(h * ODD))
        owner.append(word[inside])
    # the whole word: a polynomial of its bytes
    power = np.cumprod(np.full(int(lengths.max()), ODD), dtype=np.uint64)
    whole = np.add.reduceat(mixed(values * ODD) * power[np.arange(len(data)) - np.repeat(starts, lengths)], starts)
    found.append(mixed(whole))
    owner.append(np.arange(len(words)))
    order = np.argsort(np.concatenate(owner), kind="stable")
    numbers = (np.concatenate(found) >> SHIFT).astype(np.int64)[order]
    return numbers, np.bincount(np.concatenate(owner), minlength=len(words))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], held: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str],
        epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Examples are (language, distinct subwords, counts); `held` are set aside for the calibration."""
    rng = np.random.Generator(np.random.PCG64(1))
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    w = np.zeros((WIDTH + 1, len(languages)))
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, found, counts = examples[k]
            now = rate * (1 - step / steps)
            step += 1
            share = counts / counts.sum()
            mean = np.append(share @ e[found], 1.0)
            g = softmax(mean @ w)
            g[y] -= 1.0
            back = w[:WIDTH] @ g
            w -= now * np.outer(mean, g)
            # a subword's step is not shrunk with the length of its text
            e[found] -= np.outer(now * share / share.max(), back).astype(np.float32)
    return calibrated(Model(languages, e, w, 1.0, 0.0), held)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def calibrated(model: Model, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The model with the temperature of the largest likelihood, and the least probability that keeps FAITH of the texts right."""
    if not held:
        return model
    y = np.array([k for k, _, _ in held])
    z = np.array([np.append((c / c.sum()) @ model.embeddings[i], 1.0) @ model.softmax for _, i, c in held])
    rows = np.arange(len(y))
    loss = lambda t: -np.log(softmax(z / t)[rows, y] + 1e-12).mean()
    temperature = min((float(2.0 ** (x / 4)) for x in range(-4, 13)), key=loss)
    p = softmax(z / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= FAITH)
    top = p.max(1)[order]
    # nothing is known below the least certain text set aside; one in two is asked for at most where all of them may be accepted
    threshold = 1.0 if not len(good) else float(top[good[-1]]) if good[-1] + 1 < len(y) else min(float(top[-1]), 0.5)
    return model._replace(temperature=temperature, threshold=threshold)


class Scorer:
    """Probabilities of texts; words seen before are not taken apart again."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.sums, self.counts = np.zeros((CACHE, WIDTH), np.float32), np.zeros(CACHE, np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(x for x in words if x not in self.rows))
        if len(self.rows) + len(new) > CACHE:
            self.rows, new = {}, list(dict.fromkeys(words))
        if len(new) > len(self.counts) - len(self.rows):
            self.sums = np.concatenate([self.sums, np.zeros((len(new), WIDTH), np.float32)])
            self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        if new:
            at = np.arange(len(self.rows), len(self.rows) + len(new))
            numbers, many = subwords(new)
            self.sums[at] = np.add.reduceat(self.model.embeddings[numbers], np.cumsum(many) - many)
            self.counts[at] = many
            self.rows.update(zip(new, at.tolist()))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def mean(self, text: str) -> np.ndarray:
        total, many = np.zeros(WIDTH), 0
        words = words_of(text)
        for k in range(0, len(words), CHUNK):
            rows = self._rows(words[k : k + CHUNK])
            total += self.sums[rows].sum(0, dtype=np.float64)
            many += int(self.counts[rows].sum())
        return total / max(many, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([t is not None and bool(self.model.languages) and has_letter(t) for t in texts], bool)
        score, names = np.zeros(len(texts)), [UNKNOWN] * len(texts)
        if known.any():
            x = np.array([np.append(self.mean(t), 1.0) for t, k in zip(texts, known) if k])
            p = softmax(x @ self.model.softmax / self.model.temperature)
            score[known] = p.max(1)
            for i, k in zip(np.flatnonzero(known), p.argmax(1)):
                names[i] = self.model.languages[k]
        return names, score


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` documents with a language, none of them held out, as many of each language. One pass counts the
    languages; a row is taken if its hash is below its language's share, so that what the fit's task gets does not grow."""
    tell_workers(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, WIDTH), np.float32), np.zeros((WIDTH + 1, 0)), 1.0, 1.0)
    shares = docs.sparkSession.createDataFrame(
        [(k, x, sample / len(languages) / sizes[x]) for k, x in enumerate(languages)], "y int, lang string, share double")
    # the hash of an id and its text: repeated rows are taken together
    rows = usable.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("y", "h", "text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, h, text in zip(batch["y"], batch["h"], batch["text"]):
                words = words_of(text)
                at = (h >> 32) % max(1, len(words) - SLICE + 1)
                for part, piece in enumerate((words, words[at : at + SLICE])):
                    if piece:
                        found = np.unique(subwords(piece)[0], return_counts=True)
                        out.append((y, h, part, np.concatenate(found).astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["y", "h", "part", "found"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "y", "part"]).sort_values(["h", "y", "part"])
        all_of = [(y, *np.frombuffer(x, np.uint32).reshape(2, -1)) for y, x in zip(rows["y"], rows["found"])]
        apart = (rows["h"].to_numpy() >> 7) % CALIBRATE == 0
        model = fit([x for x, a in zip(all_of, apart) if not a], [x for x, a in zip(all_of, apart) if a], languages)
        return pd.DataFrame({"e": [model.embeddings.tobytes()], "w": [model.softmax.tobytes()], "t": [model.temperature], "p": [model.threshold]})

    fitted = chosen.mapInPandas(extract, "y int, h long, part int, found binary").groupBy().applyInPandas(
        train, "e binary, w binary, t double, p double").first()
    if fitted is None:  # texts without words only
        return Model([], np.zeros((1 << BITS, WIDTH), np.float32), np.zeros((WIDTH + 1, 0)), 1.0, 1.0)
    e, w = np.frombuffer(fitted["e"], np.float32).reshape(-1, WIDTH), np.frombuffer(fitted["w"]).reshape(WIDTH + 1, -1)
    return Model(languages, e, w, fitted["t"], fitted["p"])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row; the model, some megabytes, is sent to the tasks once."""
    tell_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            names, score = scorer.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": score,
                                "accepted": (score >= shared.value.threshold) & (score > 0)})

    # a number travels as text, so that pandas does not turn missing ones into floats
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(predict, "doc_id string, lang_pred string, score double, accepted boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identified(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
