"""The operators against plain versions on small inputs."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from basketlens.llm import bpe, chat, common, minhash, mixing, neighbours, pii, repeats, shards, topk, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ shared helpers


def test_components(spark):
    rnd = random.Random(1)
    for edges in ([(i, i + 1) for i in range(200)], [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)],
                  [(7, i) for i in range(50)] + [(3, 4)], []):
        got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [e for e in edges if e[0] != e[1]]
        assert got == brute.closure(sorted({x for e in real for x in e}), real)


def test_numbered_is_dense_and_in_order(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("k")).repartition(9)
    got = sorted((r.i, r.k) for r in common.numbered(df, "i", F.col("k")).collect())
    assert [i for i, _ in got] == list(range(5_000)) and [k for _, k in got] == sorted(k for _, k in got)


# ------------------------------------------------------------------ chat


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    talks = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [a, c], 6: [b], 7: [("user", None)], 8: [("user", "")], 9: [(None, "hi")]}
    rows = [(k, i, *turn) for k, turns in talks.items() for i, turn in enumerate(turns)]
    rows += [(3, 0, *a)]  # a row logged twice
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8, 9]
    assert got[3].copies == 2 and got[3].n_turns == 3
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[9].rendered.startswith("<|im_start|>unknown\n") and got[7].rendered == got[8].rendered


def test_long_conversations_cross_blocks(spark):
    rows = [(k, i, "user", f"turn {i}" if k < 3 or i != 40 else "other") for k, n in ((1, 90), (2, 70), (3, 70)) for i in range(n)]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=16)
    kept = {}
    for r in got.orderBy("conv_id", "segment").collect():
        kept.setdefault(r.conv_id, []).append(r)
    assert sorted(kept) == [1, 3]
    assert "".join(r.rendered for r in kept[1]).count("<|im_start|>") == 90 and [r.segment for r in kept[1]] == list(range(6))


def test_snapshots_that_end_inside_a_tied_turn(spark):
    import duckdb

    rows = []
    for k in range(0, 60, 2):
        rows += [(k, 0, "user", f"a{k}"), (k + 1, 0, "user", f"a{k}"), (k + 1, 0, "user", f"b{k}"), (k + 1, 1, "user", "end")]
    rows += [(100, 0, None, "x"), (101, 0, None, "x"), (101, 0, "user", None), (101, 0, "user", ""), (102, None, "user", "a"), (103, None, "user", "a"),
             (103, None, "user", "b"), (104, 300, "assistant", "yes"), (105, 300, "assistant", "yes"), (105, 300, "user", "yes"), (None, 0, "user", "q"), (None, 0, "user", "p")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(chat.SQL).fetchall(), key=str)


def test_turns_of_one_number_and_rows_without_an_id_are_cut_into_bounded_segments(spark):
    from pyspark.sql import functions as F

    loose = spark.range(3_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    hot = loose.select(F.lit(1).cast("long").alias("conv_id"), F.lit(7).cast("long").alias("turn"), "role", F.concat(F.repeat(F.lit("same beginning "), 9), F.col("text")).alias("text"))
    got = chat.collapse(loose.unionByName(hot).repartition(5)).collect()
    for key, first in ((None, lambda i: str(i)), (1, None)):
        own = sorted((r for r in got if r.conv_id == key), key=lambda r: r.segment)
        assert [r.segment for r in own] == list(range(12)) and [r.n_turns for r in own] == [256] * 11 + [184]
        texts = [p.split("\n", 1)[1] for r in own for p in r.rendered.split("<|im_end|>\n")[:-1]]
        assert texts == ([str(i) for i in range(3_000)] if first else sorted("same beginning " * 9 + str(i) for i in range(3_000)))


def test_prefix_hashes_do_not_depend_on_groups(spark):
    rows = [(k, i, "user", f"turn {i}") for k in (1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [sorted(map(tuple, chat.prefix_hashes(chat.ordered(df, b), g).select("conv_id", "pos", "n", "h1", "h2").collect())) for b, g in ((4, 3), (7, 2), (256, 65_536))]
    assert found[0] == found[1] == found[2] and len(found[0]) == 180
    assert [x[1:] for x in found[0][:90]] == [x[1:] for x in found[0][90:]] and len({x[3] for x in found[0]}) == 90


# ------------------------------------------------------------------ shards


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1_000, 4_097])
def test_permutation_is_one(n):
    slots = shards.permuted(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 17 or slots.tolist() != list(range(n)) and shards.permuted(np.arange(n), n, 5).tolist() != slots.tolist()


@pytest.mark.parametrize("kind", ["bytes", "bpe"])
def test_shards_read_back(spark, documents, tmp_path, kind):
    if kind == "bytes":
        rows, count = shards.byte_slots(documents, length=100)
    else:
        rows, count = shards.slotted(shards.sequences(documents, length=100))
    where = shards.write_shards(rows, str(tmp_path), count, slots=64).collect()
    assert sorted(r.slot for r in where) == list(range(count))
    dtype = "<u1" if kind == "bytes" else "<u2"
    table = shards.read_slots(str(tmp_path), 0, count + 10, 64, 100, dtype)
    assert table.shape == (count, 100)
    assert (shards.read_slots(str(tmp_path), 60, 70, 64, 100, dtype) == table[60:130]).all()
    parts = {}
    for r in where:
        assert zlib.crc32(table[r.slot].tobytes()) == r.crc and r.at == r.slot % 64 * 100 * (1 if kind == "bytes" else 2)
        parts.setdefault(r.doc_id, {})[r.part] = table[r.slot][: r.n_tokens]
    codec = bpe.codec(bpe.default_vocabulary())
    for doc, text in texts_of(documents):
        ids = np.concatenate([parts[doc][i] for i in range(len(parts[doc]))])[:-1]
        assert (ids.tobytes() if kind == "bytes" else codec.decode(ids.tolist())).decode() == (text or "")


def test_a_filter_on_slots_works_them_out_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (None, None), (3, "c " * 900)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    rows, count = shards.bpe_slots(spark.read.parquet(str(tmp_path / "docs")), length=64)
    wave = rows.where("slot >= 2 and slot < 5")
    assert wave._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.slot for r in wave.collect()) == [2, 3, 4] and sorted(r.slot for r in rows.collect()) == list(range(count))


def test_registered_shards_hold_vocabulary_ids(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "shared_folder", lambda _: str(tmp_path))
    where = shards.op2_shards(spark, FOLDER).collect()
    table = shards.read_slots(str(next(tmp_path.glob("shards-*"))), 0, len(where) + 1)
    assert sorted(r.slot for r in where) == list(range(len(where))) == list(range(len(table)))
    parts = {}
    for r in where:
        assert zlib.crc32(table[r.slot].tobytes()) == r.crc
        parts.setdefault(r.doc_id, {})[r.part] = table[r.slot][: r.n_tokens].tolist()
    texts = texts_of(documents)
    codec = bpe.codec(bpe.default_vocabulary())
    for (doc, _), ids in zip(texts, codec.encode([t or "" for _, t in texts])):
        assert sum((parts[doc][i] for i in range(len(parts[doc]))), []) == [*ids, shards.END]


# ------------------------------------------------------------------ near duplicates


def near_copies(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    rows, ids = [], iter(range(10_000))
    for size, edits in ((60, 3), (25, 1), (3, 2), (2, 0)):
        base = [word() for _ in range(rnd.randint(60, 140))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = word()
            rows.append((next(ids), " ".join(w)))
    rows += [(next(ids), " ".join(word() for _ in range(rnd.randint(0, 80)))) for _ in range(150)]
    rows += [(next(ids), t) for t in (None, "", "   ", "a b", "A  B", "a b c d e", "a b c d e f", "é x É y z")]
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_lose_no_link(spark, percent):
    rows = near_copies()
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = brute.near_duplicates(rows, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(brute.shingles(t)) and r.kept == (want[i] == i) for i, t in rows for r in [got[i]])


def test_near_duplicates_of_the_tables(documents):
    rows = texts_of(documents)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents).collect()}
    assert got == brute.near_duplicates(rows)


def test_large_groups_use_the_prefix_filter(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CENTRES", ())
    monkeypatch.setattr(minhash, "FEW", 2)
    rows = near_copies(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_signature_holds_both_ends():
    s = [minhash.shingles(minhash.lower_words(t)) for t in (b"a b c d e f g", b"a b c d e f h")]
    sig = minhash.signatures(s)
    for i, x in enumerate(s):
        y = x * minhash.MULTIPLIERS[0]
        y ^= y >> np.uint64(29)
        assert sig[i, 0] == y.min() and sig[i, 1] == y.max()


# ------------------------------------------------------------------ mixing


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), s) for i, s in enumerate(["a"] * 900 + ["b"] * 400 + [None] * 300 + ["c"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.measured(df)
    out = mixing.with_copies(sized, mixing.source_targets(sized)).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    targets = {r.source: r["__mix"].target for r in out}
    sizes = {r.source: r["__mix"].source_size for r in out}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    level = {s: targets[s] / weights[s] for s in targets if targets[s] < 2 * sizes[s] - 1e-6}
    assert all(x == pytest.approx(max(level.values())) for x in level.values())
    for s in targets:
        taken = sum(r["__mix"].size * r["__mix"].copies for r in out if r.source == s)
        assert taken == pytest.approx(targets[s], rel=0.12) and all(r["__mix"].copies <= 2 for r in out)
    mixed = mixing.mixture(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["__mix"].copies for r in out)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mixture(df.repartition(7)).collect())


# ------------------------------------------------------------------ personal data


def hard_texts():
    rnd = random.Random(4)
    bits = ["a", "b.c", "@", "x-y", ".", "1", "23", "255", "256", "4111 1111", "1111-1111", "5927243074273351", " ", "-", "+1 (017) 555-7713",
            "+", "(", ")", "é", "\U0001f642", "\n", "_d@e.f", "10.0.0.1", "00255", "a@b.c", "[at]", "(dot)"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(2_000)]
    return rows + [(9_000, None), (9_001, ""), (9_002, "1 " * 30_000), (9_003, "a" * 100_000 + "@b" + ".c" * 30_000),
                   (9_004, "9" * 80_000), (9_005, "+1" + " 2" * 30_000), (9_006, "1.2.3.4." * 9_000)]


def test_base_spans(spark):
    rows = hard_texts()
    df = pii.proposed(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in df.select("doc_id", pii.listed(F.col("__base")).alias("base"), *[F.size(pii.of_kind("__base", k)).alias(k) for k in pii.KINDS]).collect()}
    for i, text in rows:
        want = brute.pii(text or "")
        assert got[i].base == ",".join(want["base"]), text[:200]
        assert all(got[i][k] == want["n_" + k] for k in pii.KINDS)


def test_spans_keep_the_base_and_touch_nothing_else(spark):
    real = [(i, f"call +1 ({i % 900:03d}) 555-{i % 9000:04d} now") for i in range(400)]
    bare = [(1_000 + i, f"call ({i:03d}) 555-{i:04d} now") for i in range(3)]
    plain = [(2_000 + i, f"year {1900 + i} page {i}.{i} of the book") for i in range(200)]
    df = spark.createDataFrame(real + bare + plain, "doc_id long, text string")
    found = pii.proposed(df)
    out = {r.doc_id: r for r in found.select("doc_id", pii.listed(F.col("__base")).alias("b"), pii.listed(pii.all_spans(pii.learn(found))).alias("s")).collect()}
    assert all(set(r.b.split(",")) <= set(r.s.split(",")) for r in out.values() if r.b)
    assert all(out[i].s.startswith("phone:5:") for i, _ in real)
    assert all(out[i].s == "" for i, _ in plain)


def test_redaction(spark):
    rows = [(1, "x a.b@c.de y 10.0.0.1"), (2, None), (3, ""), (4, "clean é text"), (5, "\U0001f642 +1 (017) 555-7713!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(texts_of(pii.redacted(df)))
    assert got == {1: "x [EMAIL] y [IP]", 2: None, 3: "", 4: "clean é text", 5: "\U0001f642 [PHONE]!"}


def test_phones_of_short_groups(spark):
    rows = [(1, "+33 6 12 34 56 78"), (2, "call +45 12 34 56 78 or +4 (5) 6-7.8 9 0 1!"), (3, "+1 2 3"), (4, "12 34 56 78"), (5, "+1 2" + " 34" * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", pii.listed(pii.base_spans(F.col("text"))).alias("base")).collect()}
    assert [got[i].base.count("phone") for i, _ in rows] == [1, 2, 0, 0, 0]
    assert all(got[i].base == ",".join(brute.pii(t)["base"]) for i, t in rows)
    assert dict(texts_of(pii.redacted(df))) == dict(rows) | {1: "[PHONE]", 2: "call [PHONE] or [PHONE]!"}


def luhn(prefix):
    """The number with its check digit."""
    return next(prefix + c for c in "0123456789" if sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, (prefix + c)[::-1]))) % 10 == 0)


def test_which_candidates_are_added(spark):
    rnd = random.Random(5)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    spaced = lambda d: f"{d[:4]} {d[4:10]} {d[10:]}"
    rows, want = [], {}

    def add(text, more):
        want[len(rows)] = more and f"{more[0]}:{text.index(more[1])}:{text.index(more[1]) + len(more[1])}"
        rows.append((len(rows), text))

    for _ in range(1_500):
        add(f"write to u{digits(3)}@host.org today", None)
        add(f"call +44 {digits(2)} {digits(4)} {digits(4)} now", None)
        add(f"host 10.{rnd.randint(0, 255)}.0.{rnd.randint(0, 255)} is up", None)
        card = spaced(luhn("37" + digits(12)))
        add(f"paid with {card} yesterday", ("card", card))  # 15 digits: no strict card
        add(f"order {luhn('8' + digits(11)) if rnd.random() < 0.1 else '8' + digits(12)} shipped", None)  # 13 digits, few pass by chance
        add(f"page {digits(3)} of {digits(3)}, version 3.{digits(1)}", None)
    for _ in range(3):
        mail, host, phone, bare = f"u{digits(3)} (at) host [dot] org", "10[.]7[.]0[.]9", f"0044 20 {digits(4)} {digits(4)}", f"20 {digits(4)} {digits(4)}"
        add(f"write to {mail} today", ("email", mail))
        add(f"host {host} is up", ("ip", host))
        add(f"call {phone} now", ("phone", phone))
        add(f"call {bare} now", ("phone", bare))
        bad = spaced("37" + digits(12) + "0")
        while luhn(bad.replace(" ", "")[:-1])[-1] == "0":
            bad = spaced("37" + digits(12) + "0")
        add(f"paid with {bad} yesterday", None)
        add("host 300[.]7[.]0[.]9 is up", None)
        add("list 1. 2. 3. 4 and you @ 5.pm there", None)
    found = pii.proposed(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = pii.all_spans(pii.learn(found))
    out = {r.doc_id: set(r.s.split(",")) - set(r.b.split(",")) for r in found.select("doc_id", pii.listed(F.col("__base")).alias("b"), pii.listed(spans).alias("s")).collect()}
    assert {i: x for i, x in out.items() if x != ({want[i]} if want[i] else set())} == {}


def test_limits_are_calibrated():
    scores = np.array([3.0, 2.0, 1.0, 0.0])
    assert pii._limit(scores, np.array([500.0, 400, 10, 0]), np.array([0.0, 2, 5, 90])) == 2.0
    assert pii._limit(scores, np.array([20.0, 0, 0, 0]), np.zeros(4)) is None  # too few to be sure
    assert pii._limit(scores, np.array([10.0, 400, 0, 0]), np.array([5.0, 0, 0, 9])) == 2.0  # pooled with what it should beat
    assert pii._limit(np.empty(0), np.empty(0), np.empty(0)) is None


# ------------------------------------------------------------------ BPE


def test_ids_are_those_of_the_library():
    import public_tokenizers
    import tiktoken

    codec = bpe.codec(bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(1)
    bits = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "é", "1", "٣", "!", "…", "Z", " ", "　", "d", "m",
            "漢", "\U0001f642", "a'", "\x1c", "\x85", " ", "<|endoftext|>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(5_000)]
    texts += ["", " " * 5_000, "ab" * 40_000, "a" * 1_000, "\n" * 999 + "x", " x" * 70_000]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        at = codec.offsets(ids)
        assert all(text.encode()[a : a + len(codec.pieces[i])] == codec.pieces[i] for a, i in list(zip(at.tolist(), ids))[:50])


def test_scan_crosses_its_blocks(monkeypatch):
    codec = bpe.codec(bpe.default_vocabulary())
    text = "don't  stop\n\n we'll see 123 it's...  ok " * 40
    want = list(codec.encode([text]))
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert list(codec.encode([text])) == want
    monkeypatch.setattr(bpe, "CHUNK", 50)
    assert list(codec.encode([text, "", text])) == [want[0], [], want[0]]


def test_ends_of_blocks_stand_for_them(monkeypatch):
    codec = bpe.codec(bpe.default_vocabulary())
    text = "don't  stop\n\n we'll've see 123 it's...  ok 're 'rest" * 40
    want = list(codec.encode([text]))
    for block in (2, 7, 64):
        for tail in (1, 2, 3, 100):  # one symbol often leaves the state open
            monkeypatch.setattr(bpe, "BLOCK", block)
            monkeypatch.setattr(bpe, "TAIL", tail)
            assert list(codec.encode([text])) == want


def test_long_slices_are_merged_together(monkeypatch):
    import public_tokenizers
    import tiktoken

    codec = bpe.Codec(bpe.default_vocabulary())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    alone, merged = [], bpe.Codec.merged
    monkeypatch.setattr(bpe.Codec, "merged", lambda self, piece: alone.append(len(piece)) or merged(self, piece))
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choice("abcdeéing漢tion") for _ in range(rnd.randint(1, 80))) for _ in range(60)) for _ in range(30)]
    monkeypatch.setattr(bpe, "ROWS", 7)
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    assert alone and min(alone) > bpe.LONG == 63
    monkeypatch.setattr(bpe, "CACHE", 20)  # emptied again and again
    assert list(bpe.Codec(bpe.default_vocabulary()).encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_table_keeps_most_of_many_slices(monkeypatch):
    codec = bpe.Codec(bpe.default_vocabulary())
    text = " ".join(np.base_repr(i * 7919 + 10**9, 26) for i in range(300_000)).translate(str.maketrans("0123456789", "qrstuvwxyz"))
    first = list(codec.encoded([text]))[0]
    new, seen = bpe.Codec._new, []
    monkeypatch.setattr(bpe.Codec, "_new", lambda self, raw, at, *more: seen.append(len(at)) or new(self, raw, at, *more))
    assert (list(codec.encoded([text]))[0] == first).all() and sum(seen) < 60_000


def test_documents_come_back(documents):
    encoded = bpe.encode(documents)
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(documents).collect()}
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    for doc, text in texts_of(documents):
        raw = (text or "").encode()
        assert got[doc] == raw and trip[doc].decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert trip[doc].n_tokens == len(ids[doc]) and trip[doc].ids_sha256 == hashlib.sha256(",".join(map(str, ids[doc])).encode()).hexdigest()


# ------------------------------------------------------------------ repeats


def test_deep_shallow_sorts():
    rnd = random.Random(2)
    for _ in range(100):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(5, 30))) for _ in range(4)]
        s = [b"".join(rnd.choice(parts) for _ in range(20))[:50].ljust(50, b"a") for _ in range(rnd.randint(1, 60))]
        words = np.array([[int.from_bytes(x[8 * i : 8 * i + 8], "big") for i in range(7)] for x in s], np.uint64)
        order, new = repeats.deep_shallow(words)
        out = [s[i] for i in order]
        assert out == sorted(s) and [bool(x) for x in new] == [i == 0 or out[i] != out[i - 1] for i in range(len(s))]


@pytest.mark.parametrize("many", [256, 8])
def test_repeats_match_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "GROUP", 20_000)
    rnd = random.Random(many)
    parts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(20, 120))) for _ in range(40)] + ["é" * 40, " " * 70, "x"]
    rows = [(i, "".join(rnd.choice(parts) + ("" if rnd.random() < 0.5 else str(rnd.random())[: rnd.randint(2, 5)]) for _ in range(rnd.randint(0, 9))))
            for i in rnd.sample(range(5_000), 500)]
    rows += [(9_000 + i, rnd.choice(rows)[1]) for i in range(60)] + [(9_990, None), (9_991, "q" * 49), (9_992, "q" * 50)]
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.repeats([(i, (t or "").encode()) for i, t in rows])
    assert {i: (r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == want


# ------------------------------------------------------------------ neighbours and search


def vectors(spark, extra=()):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1):
        for size, noise in ((80, 0.01), (30, 0.02), (2, 0.01), (200, 1.0)):
            centre = rng.normal(size=16)
            for _ in range(size):
                x = centre + rng.normal(size=16) * noise if noise < 1 else rng.normal(size=16)
                rows.append((n, [float(v) for v in x.astype(np.float32)], label))
                n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(40)]  # copies
    return rows + list(extra)


BAD = [(5_001, None, 0), (5_002, [], 0), (5_003, [0.0] * 16, 0), (5_004, [float("nan")] + [1.0] * 15, 0), (5_005, [None] + [1.0] * 15, 0),
       (5_006, [1.0] * 16, None), (5_007, [float("inf")] + [1.0] * 15, 1), (5_008, [1.0, 2.0], 0), (5_009, [2.0, 4.0], 0)]


def test_links_of_vectors(spark):
    rows = vectors(spark, BAD)
    got = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[:i] if a[2] == b[2] and len(a[1]) == len(b[1])
             and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    want = brute.closure([r[0] for r in rows], links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {r[0]: sum(r[0] in x for x in links) for r in rows}
    assert all(r.kept == (want[i] == i) for i, r in got.items())


def test_tight_groups_link_beyond_full_lists(spark):
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
    rows = []
    for label, cosine in ((0, 0.985), (1, 0.9)):  # groups that meet, groups that do not
        for centre in (a, cosine * a + math.sqrt(1 - cosine**2) * b):
            for _ in range(40):
                rows.append((len(rows), [float(v) for v in (centre + rng.normal(size=24) * 0.003).astype(np.float32)], label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])) & ~np.eye(len(rows), dtype=bool)
    want = brute.closure([r[0] for r in rows], [(int(i), int(j)) for i, j in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in neighbours.near_vectors(df).collect()}
    assert len(set(want.values())) == 3
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (near[i].sum(), c, c == i) for i, c in want.items()}


def test_audit_goes_on_to_the_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1_000, 24))
    rows = [(i, [float(v) for v in y.astype(np.float32)], 0) for i, y in enumerate([*x, x[500] + 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, known = neighbours.nodes(df)
    none = spark.createDataFrame([], "id long, others long, component long")
    assert neighbours.recall(none, known, 0.98, audited=20) == 0
    pair = spark.createDataFrame([(500, 1, 500), (1_000, 1, 500)], none.schema)
    assert neighbours.recall(pair, known, 0.98, audited=200) == 1


def test_exact_way_when_the_lists_stay_incomplete(spark, monkeypatch):
    rows = vectors(spark, BAD)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = sorted(tuple(r) for r in neighbours.near_vectors(df).collect())  # held against brute force above
    monkeypatch.setattr(neighbours, "ATTEMPTS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 32)  # several leaders, parts and salts
    monkeypatch.setattr(neighbours, "ROWS", 100)
    monkeypatch.setattr(neighbours, "recall", lambda *_: 0.0)
    monkeypatch.setattr(neighbours, "links_of", lambda *_: spark.createDataFrame([], "id long, others long, component long"))
    assert sorted(tuple(r) for r in neighbours.near_vectors(df).collect()) == want


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in (rng.normal(size=12) if i % 9 else np.ones(12)).astype(np.float32)], 0) for i in range(700)]
    rows += [r for r in BAD if r[2] is not None] + [(6_000, [1e30] * 12, 0), (6_050, [-1e30] * 12, 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    good = [(i, [int(math.floor(256 * float(np.float32(v)))) for v in x]) for i, x, _ in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    want = []
    for q, x in {i: x for i, x in good if i % 50 == 0}.items():
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in good if i != q and len(x) == len(y))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:5])]
    assert sorted(got) == sorted(want)


# ------------------------------------------------------------------ toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    hit = [i for i in held if got[i].predicted == 1]
    assert sum(labels[i] for i in hit) >= 0.97 * len(hit) and sum(labels[i] for i in hit) >= 0.85 * sum(labels[i] for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_learns_words_not_length(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("klmnop") for _ in range(4))
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [word() for _ in range(rnd.randint(1, 200))]
        for _ in range(3 * toxic):
            text.insert(rnd.randrange(len(text)), "vile" + word())
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (None, "vilexx vileyy vilezz"), (902, "vileab vilecd " * 4_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    score = toxicity.scorer(model)
    got = {r.doc_id: r.s for r in df.select("doc_id", score(F.col("text")).alias("s")).collect()}
    wrong = [i for i, y in labels if (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 6 and got[None] > 0.5 and got[902] > 0.5 and got[900] == got[901] < 0.5
    nothing = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.bias == toxicity.UNKNOWN and len(nothing.index) == 0


def test_ftrl_against_plain(monkeypatch):
    """Weights of a plain, coordinate by coordinate FTRL-proximal over the same examples; the bias is as it was fitted."""
    from basketlens.llm import toxicity

    rng = np.random.default_rng(2)
    examples = []
    for _ in range(60):
        found = np.sort(rng.choice(12, 5, replace=False)).astype(np.uint32)
        examples.append((int(found[0] < 2 or rng.random() < 0.2), found, rng.integers(1, 4, 5).astype(np.uint32)))
    monkeypatch.setattr(toxicity, "L1", 0.5)
    model = toxicity.fit(examples, epochs=3, rare=2)
    z, n = {}, {}

    def weight(i):
        l1, l2 = (0.0, 0.0) if i < 0 else (toxicity.L1, toxicity.L2)
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + l2)

    for _ in range(3):
        for y, found, counts in examples:
            x = {-1: 1.0, **{int(i): math.log1p(int(c)) for i, c in zip(found, counts)}}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i] * (toxicity.POSITIVE if y else 1.0)
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i >= 0 and weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want) and model.bias == pytest.approx(weight(-1))
    flipped = toxicity.fit([(1, f, c) for _, f, c in examples[:50]] + [(0, f, c) for _, f, c in examples[50:]])
    assert flipped.bias > toxicity.UNKNOWN  # mostly toxic labels are not held down
