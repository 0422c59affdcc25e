"""The pipeline's stages against plain versions, each on its own input."""

import os
import zlib

import pytest

import brute
import corpus_pipeline
from basketlens.llm import bpe, minhash, toxicity
from basketlens.session import written

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], FOLDER)))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_toxicity_drops_what_it_rejects(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {i for i, _ in rows(steps[1])}
    seen = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    assert all(i not in kept for i in seen if labels[i] == 1)
    clean = [i for i in labels if labels[i] == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert rows(toxicity.without_toxic(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet")).orderBy("doc_id")) == sorted(rows(steps[1]))


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    component = brute.near_duplicates(before, 80)
    assert sorted(rows(steps[2])) == sorted((i, t) for i, t in before if component[i] == i)
    assert len(before) > len(rows(steps[2]))


def test_personal_data_is_gone(steps):
    before, after = dict(rows(steps[2])), dict(rows(steps[3]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        found = brute.pii(text or "")["base"]
        if found:
            assert not brute.pii(after[i])["base"] and after[i].count("[") >= text.count("[") + 1
    changed = [i for i in before if before[i] != after[i]]
    assert len(changed) < 0.2 * len(before)
    assert all(r.n_chars == len(r.text) for r in steps[3].where("text is not null").collect())


def test_mix_repeats_whole_documents(steps):
    before = dict(rows(steps[3]))
    taken = {}
    for i, text in rows(steps[4]):
        assert before[i] == text
        taken[i] = taken.get(i, 0) + 1
    assert max(taken.values()) <= 2
    words = lambda i: len(brute.words(before[i]))
    assert sum(words(i) * k for i, k in taken.items()) == pytest.approx(1.5 * sum(map(words, before)), rel=0.1)


def test_ids_decode_to_the_texts(steps):
    codec = bpe.codec(bpe.default_vocabulary())
    texts = dict(rows(steps[4]))
    out = steps[5].collect()
    assert len(out) == steps[4].count() and all(r.exact and r.n_tokens == len(r.ids) for r in out)
    assert all(codec.decode(r.ids).decode() == (texts[r.doc_id] or "") for r in out)


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == steps[-1].columns and got.count() == steps[-1].count()
    assert minhash.WORDS == 5
