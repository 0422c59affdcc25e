"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and pipeline stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens.llm import bpe, chat, minhash, mixing, neighbours, pii, repeats, shards, topk, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

LONG = "word " * 40_000
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 15), (1, "a b c d e f g h", "en", "s1", 15), (1, "another text", "en", "s1", 12),
    (2, None, None, None, None), (3, "", "en", None, 0), (None, "a b c d e f g h", "en", "s2", 15), (None, None, None, None, None),
    (4, LONG, "en", "s2", len(LONG)), (5, LONG, "en", "s3", len(LONG)), (6, " \n\t ", "en", "s3", 4), (7, "x" * 150_000, "en", "s3", 1),
    (8, "mail a.b@c.de or +1 (017) 555-7713", "en", "s1", 1), (-9, "é\U0001f642 漢", "en", "s1", 1),
]
CLASH = ("t", "g", "n", "key", "size", "draw", "slot", "shard", "component", "id", "bands", "x", "score", "copies", "index")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (None, 1), (8, None)], "doc_id long, toxic int")


def operators(spark, labels, folder):
    return {
        "minhash": minhash.near_duplicates,
        "mixing": lambda d: mixing.with_copies(mixing.measured(d), mixing.source_targets(mixing.measured(d))),
        "mixture": mixing.mixture,
        "pii": lambda d: (lambda f: f.select("doc_id", pii.listed(pii.all_spans(pii.learn(f))).alias("s")))(pii.proposed(d)),
        "redacted": pii.redacted,
        "bpe": bpe.round_trip,
        "repeats": repeats.without_repeats,
        "toxicity": lambda d: d.select("doc_id", toxicity.scorer(toxicity.learn(d, labels))(F.col("text")).alias("s")),
        "shards": lambda d: shards.slotted(shards.sequences(d))[0],
    }


@pytest.mark.parametrize("name", ["minhash", "mixing", "pii", "redacted", "bpe", "repeats", "toxicity"])
def test_every_row_has_a_result(spark, odd, labels, name, tmp_path):
    out = operators(spark, labels, tmp_path)[name](odd)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", ["minhash", "mixing", "mixture", "pii", "redacted", "bpe", "repeats", "toxicity", "shards"])
def test_empty_tables(spark, odd, labels, name, tmp_path):
    assert operators(spark, labels, tmp_path)[name](odd.where("false")).count() == 0


def test_clashing_columns_come_through(spark, odd):
    for out in (mixing.mixture(odd), pii.redacted(odd), minhash.without_near_duplicates(odd)):
        assert out.columns == odd.columns and out.where("t <> 'clash' or component <> 'clash'").count() == 0


def test_defined_results(spark, odd):
    near = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert near.count((1, 4, 1, True)) == 2 and (2, 0, 2, True) in near and (None, 4, None, True) in near and (5, 1, 4, False) in near
    kept = minhash.without_near_duplicates(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 1, 2, 3, None, None, 4, 6, 7, 8, -9]))
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.without_repeats(odd).collect()}
    assert cut[5, len(LONG)] == len(LONG) and cut[4, len(LONG)] == 0 and cut[None, 15] == 0 and cut[2, 0] == 0
    trip = {(r.doc_id, r.n_tokens) for r in bpe.round_trip(odd).collect()}
    assert (2, 0) in trip and (3, 0) in trip and (None, 0) in trip


def test_shards_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "docs"))
    rows, count = shards.byte_slots(spark.read.parquet(str(tmp_path / "docs")), length=64)
    where = shards.write_shards(rows, str(tmp_path), count, slots=100).collect()
    assert sorted(r.slot for r in where) == list(range(count))
    assert count == sum(-(-(len((r[1] or "").encode()) + 1) // 64) for r in ROWS)
    empty = spark.read.parquet(str(tmp_path / "docs")).where("false")
    rows, count = shards.byte_slots(empty)
    assert count == 0 and shards.write_shards(rows, str(tmp_path), count).count() == 0


def test_bpe_shards_of_odd_rows(spark, odd, tmp_path):
    odd.withColumn("_metadata", F.lit("clash")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows, count = shards.bpe_slots(docs, length=64)
    where = shards.write_in_waves(rows, str(tmp_path), count, slots=100, waves=3, stride=128, fill=shards.END.to_bytes(2, "little")).collect()
    assert sorted(r.slot for r in where) == list(range(count)) and {r.n_bytes for r in where} == {128}
    got = sorted((str(r.doc_id), r.part, shards.read_slots(str(tmp_path), r.slot, 1, 100, 64)[0][: r.n_tokens].tolist()) for r in where)
    want = [(str(d), i, [*ids, shards.END][i * 64 : (i + 1) * 64]) for (d, t, *_), ids in zip(ROWS, bpe.codec(bpe.default_vocabulary()).encode([r[1] or "" for r in ROWS]))
            for i in range(len(ids) // 64 + 1)]
    assert got == sorted(want)
    rows, count = shards.bpe_slots(docs.where("false"))
    assert count == 0 and shards.write_in_waves(rows, str(tmp_path), count).count() == 0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, h1 string, block string, pos string"
    rows = [(None, None, None, None, "c", "c", "c"), (1, 0, "user", LONG, "c", "c", "c"), (1, 0, "user", LONG, "c", "c", "c"),
            (2, 5, "user", "x", "c", "c", "c"), (2, 5, "user", "y", "c", "c", "c"), (3, None, "user", "x", "c", "c", "c")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.segment): r for r in chat.collapse(df).collect()}
    assert got[1, 0].n_turns == 1 and got[2, 0].n_turns == 2 and (None, 0) in got
    assert chat.collapse(df.where("false")).count() == 0


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 0, "c"), (1, [1.0, 0.0], 0, "c"), (None, [1.0, 0.0], 0, "c"), (2, None, 0, "c"), (3, [], 0, "c"), (4, [0.0, 0.0], 0, "c"),
            (50, [1.0, 0.0], None, "c"), (100, [1.0], 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, sim string").withColumn("id", F.lit("c"))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(df).collect()]
    assert got.count((1, 1, 1, True)) == 2 and (None, 0, None, True) in got and (2, 0, 2, True) in got and len(got) == 8
    best = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in best if r.query_id == 50][:2] == [(50, 1, 1, 65536), (50, 2, 1, 65536)]
    empty = df.where("false")
    assert neighbours.near_vectors(empty).count() == 0 and topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_and_empty_tables(spark, odd, labels, stage, tmp_path):
    labels.withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    docs = odd.drop(*CLASH)
    for part, rows in (("odd", docs), ("none", docs.where("false"))):
        out = run(spark, rows, str(tmp_path))
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert out.count() >= (3 if part == "odd" else 0) and (part == "odd" or out.count() == 0)
