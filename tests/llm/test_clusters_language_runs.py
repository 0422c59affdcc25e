"""Centroid clustering, language identification and periodic runs against plain versions, and their edges."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import language, lloyd, runs

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CLASH = ("x", "group", "block", "ids", "cluster", "runs", "best", "h", "y", "number", "score", "n")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --------------------------------------------------------------------------- runs


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            most, n = rng.choice([1, 2, 3, 4, 10, 1000]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150])
            w = [b"%d" % rng.randrange(most) for _ in range(n)]
            w = runs.looped(w, rng.randrange(1 << 28) * 10) if rng.random() < 0.6 else w
            if rng.random() < 0.5:
                u = [b"%d" % rng.randrange(most) for _ in range(rng.randint(1, 9))]
                w = w + u * rng.randint(3, 9) + u[: rng.randrange(len(u))] + w[:3]
            texts.append(w)
        assert [list(map(tuple, r.tolist())) for r in runs.runs_of(texts)] == [plain_runs(w) for w in texts]


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 500)
    tree = runs.Wavelet(values, 7)
    left = rng.integers(0, 400, 50)
    right, x = left + rng.integers(1, 100, 50), rng.integers(0, 100, 50)
    assert tree.below(left, right, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(left, right, x)]
    k = (right - left) // 2
    assert tree.smallest(left, right, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(left, right, k)]


@needs_tables
def test_runs_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 8_000]
    got = {r[0]: tuple(r) for r in runs.op13_runs(spark, FOLDER).collect()}
    assert len(got) == docs.count()
    for doc_id, text in rows:
        assert got[doc_id] == plain_row(doc_id, text)


def test_runs_edges(spark, tmp_path):
    long = "a b " * 60_000
    rows = [(1, "x x x x x x"), (1, "x x x x x x"), (None, "a b c " * 4), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "x" * 100_000), (7, "a\x00b a b ä")]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op13_runs(spark, str(tmp_path)).collect()]
    key = lambda r: str(r[0])
    small = [r for r in rows if r[0] != 5]
    assert sorted((r for r in got if r[0] != 5), key=key) == sorted((plain_row(*r) for r in small), key=key)
    assert next(r for r in got if r[0] == 5)[1] >= 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(empty).count() == 0


# --------------------------------------------------------------------------- clusters


def plain_lloyd(rows, k, scale, rounds):
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] for _, v in rows]
    order = sorted(range(len(x)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i]))
    centres = [x[i] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))[::-1] for v in x]

    for _ in range(rounds):
        labels = [a[0] for a in assign()]
        for j in range(len(centres)):
            own = [v for v, c in zip(x, labels) if c == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own)] if own else centres[j]
    return sorted(((r[0], *a) for r, a in zip(rows, assign())), key=str), centres


@pytest.mark.parametrize("n,dimensions,k", [(300, 5, 7), (40, 40, 16), (3, 4, 16), (60, 2, 3)])
def test_lloyd_against_plain(spark, monkeypatch, n, dimensions, k):
    monkeypatch.setattr(lloyd.blocks_of, "__defaults__", (16, lloyd.BLOCK))
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=(n, dimensions)) * (1 if dimensions > 2 else 0.02), 1)  # many ties
    rows = [(None if i % 23 == 5 else i // 2, [float(c) for c in v]) for i, v in enumerate(values)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got, centres = lloyd.clustered(df, k, 64, dimensions, 3)
    want, expected = plain_lloyd(rows, k, 64, 3)
    assert sorted(map(tuple, got.collect()), key=str) == want and centres.tolist() == expected


def test_lloyd_edges(spark, tmp_path):
    good = [0.5] * 64
    rows = [(1, good), (1, good), (2, None), (3, []), (4, [0.0] * 63), (5, [float("nan")] * 64), (6, [*good[:-1], None]), (7, [float("inf")] * 64), (None, good)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r)[:5] for r in lloyd.op11_clusters(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [(1, 0, 0, 0, 0), (1, 0, 0, 0, 0), (None, 0, 0, 0, 0)]
    df.where("false").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert lloyd.op11_clusters(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="a component is"):
        lloyd.clustered(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<float>").select(
            "vec_id", F.transform("embedding", lambda x: F.lit(1e300)).alias("embedding")), 16, 64, 64, 1)


# --------------------------------------------------------------------------- language


@needs_tables
def test_language_on_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    out = language.op12_language(spark, folder).join(docs, "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(out) == docs.count() and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    taken = [r for r in held if r.accepted]
    assert sum(r.lang == r.lang_pred for r in taken) / len(taken) >= 0.98 and len(taken) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_subwords_do_not_depend_on_neighbours():
    words = ["straße", "a", "漢字", "the", "zz"]
    numbers, many = language.subwords(words)
    parts = np.split(numbers, np.cumsum(many)[:-1])
    for word, part in zip(words, parts):
        alone, n = language.subwords([word])
        size = len(("<" + word + ">").encode())
        assert sorted(part) == sorted(alone) and n[0] == 1 + sum(max(0, size - k + 1) for k in language.NGRAMS)


def test_scorer_cache_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], rng.normal(size=(1 << language.BITS, language.WIDTH)).astype(np.float32), rng.normal(size=(language.WIDTH + 1, 2)), 1.0, 0.5)
    texts = ["one two three four", "five six", None, "12 !", "one five seven"] * 3
    wide = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "CACHE", 3)
    monkeypatch.setattr(language, "CHUNK", 2)
    tight = language.Scorer(model).predict(texts)
    assert wide[0] == tight[0] and np.allclose(wide[1], tight[1]) and wide[0][2] == wide[0][3] == "und"


def test_language_edges(spark):
    text = {"en": "the cat and the dog with the bird", "de": "der hund und die katze mit dem vogel"}
    rows = [(i, text[x] + f" {i}", x) for i in range(120) for x in ("en", "de")]
    odd = [(None, "the dog", None), (1, None, "en"), (2, "", "en"), (3, "12 ½ ²!", None), (4, "word " * 50_000, None), (5, "漢字", None), (6, "the cat", "en"), (6, "the cat", "en")]
    docs = clashing(spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string"))
    model = language.learn(docs)
    out = [tuple(r) for r in language.identified(docs, model).collect()]
    assert len(out) == len(rows) + len(odd)
    got = {r[0]: r[1:] for r in language.identified(docs.limit(0).union(clashing(spark.createDataFrame(odd, "doc_id long, text string, lang string"))), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0, False)
    assert got[6][0] == "en" and got[None][0] == "en" and got[5][0] in ("de", "en")
    right = [r for r in language.identified(docs, model).join(docs.select("doc_id", F.col("text").alias("t"), "lang"), "doc_id").where("doc_id > 20 and (t like '%hund%') = (lang_pred = 'de')").collect()]
    assert right
    nothing = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(docs.where("false"), language.learn(docs.where("false"))).count() == 0
