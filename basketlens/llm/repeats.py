"""Suffix-array dedup: bytes of a text that lie in a stretch of `LENGTH` bytes which an earlier document holds too are removed.

Sorting every suffix of the corpus would shuffle many times its size, so suffixes are sorted only where a repeat can be. Of the
24-byte strings in a window of LENGTH bytes the one with the smallest hash (the leftmost of equal ones) is the window's anchor;
equal windows have equal anchors, and neighbouring windows mostly share theirs. Then

1. anchors that two documents hold are found from their hashes alone, a row for each anchor and group of documents;
2. each run of windows with such an anchor becomes a context: the run's bytes. Contexts that are equal as a whole are settled by
   the smallest doc_id that has them;
3. different contexts with one anchor are cut into suffixes, which are put in order by deep-shallow sorting: multikey quicksort
   over words of eight bytes to a depth of 40, then, for what still ties, blind tries. Suffixes that agree in LENGTH bytes are
   neighbours, and all but those of the smallest doc_id are covered. Anchors with very many contexts (the edges of a passage
   that a third of all documents quote) are cut into windows that are settled one by one, spread over all tasks;
4. each document drops the union of its covered windows.

Copies of a whole text are found by its hash and take no part in 1 to 3. Texts are read in groups of bounded size by a hash of
the row. Hashes only choose where to look, bytes are compared; only a document's copies rest on a 128-bit hash.

A null text is empty. Rows without doc_id have no order: they cover nothing and keep every byte. Rows that share a doc_id do not
cover each other. Texts shorter than LENGTH keep every byte. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import table, tell_workers, written
from basketlens.llm.words import mixed

LENGTH, GRAM = 50, 24
HALF = (LENGTH - GRAM) // 2
#: Bytes of text in a group of documents, contexts of one anchor that are sorted together at most, contexts sorted at once.
GROUP, MANY, SORTED = 2 << 20, 256, 40_000
SHALLOW = 5  # words of eight bytes
_rng = np.random.Generator(np.random.PCG64(7))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position: of 1, 2, 4, ... bytes by doubling, the rest from an overlap-free pair."""
    h, power, n = BYTE[text], BASE, 1
    whole, length = None, 0
    while True:
        if GRAM & n:  # the GRAM bytes are this stretch and those of the lower bits of GRAM before it
            size = len(text) - length - n + 1
            whole = h if whole is None else whole[:size] * np.uint64(power) + h[length : length + size]
            length += n
        if 2 * n > GRAM:
            return mixed(whole)
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n


def window_anchors(h: np.ndarray) -> np.ndarray:
    """For every window the position of its anchor: the leftmost smallest of LENGTH - GRAM + 1 hashes, by doubling."""
    width, value, place, n = LENGTH - GRAM + 1, h, np.arange(len(h), dtype=np.int64), 1
    while n < width:
        step = min(n, width - n)
        less = value[step:] < value[:-step]
        value = np.where(less, value[step:], value[:-step])
        place = np.where(less, place[step:], place[:-step])
        n += step
    return place


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indices of strings of one length in order, equal ones together. A node knows a depth and a child by the byte there; a
    string goes down by those bytes alone, and one comparison with the leaf it meets shows where it branches off."""
    root: list = [len(strings[0]), [0]]  # [depth, leaf's indices] or [depth, {byte: node}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        leaf = strings[node[1][0]]
        if leaf == s:
            node[1].append(i)
            continue
        split = next(k for k, (a, b) in enumerate(zip(leaf, s)) if a != b)
        node = root
        while isinstance(node[1], dict) and node[0] < split:
            node = node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == split:
            node[1][s[split]] = [len(s), [i]]
        else:
            node[:] = [split, {leaf[split]: node[:], s[split]: [len(s), [i]]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node[1], dict):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.append(node[1])
    return out


def deep_shallow(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts a new string) of rows of big-endian words: the sorted order and where neighbours differ."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.append(True, words[order[1:], 0] != words[order[:-1], 0])
    for d in range(1, SHALLOW):  # three-way partitions: only what ties goes on to the next word
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            return order, new
        rows, part = order[tied], np.cumsum(new)[tied]
        again = np.lexsort((words[rows, d], part))
        rows, part = rows[again], part[again]
        order[tied] = rows
        new[tied[1:]] |= (words[rows[1:], d] != words[rows[:-1], d]) & (part[1:] == part[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    two = starts[sizes == 2]  # a trie of two leaves: one comparison
    if len(two):
        a, b = words[order[two], SHALLOW:], words[order[two + 1], SHALLOW:]
        differ = a != b
        first = differ.argmax(1)
        line = np.arange(len(two))
        new[two[differ.any(1)] + 1] = True
        swap = two[a[line, first] > b[line, first]]
        order[swap], order[swap + 1] = order[swap + 1].copy(), order[swap].copy()
    more = np.flatnonzero(np.repeat(sizes > 2, sizes))  # places in groups of three and more
    if len(more):
        rest = words[order[more], SHALLOW:]
        differ = np.append((rest[1:] != rest[:-1]).any(1), False)
        heads = np.flatnonzero(new[more])
        differ[np.append(heads[1:] - 1, len(more) - 1)] = False
        mixed_up = np.logical_or.reduceat(differ, heads)  # else all strings of the group are equal
    else:
        heads = mixed_up = np.empty(0, bool)
    big = sizes[sizes > 2]
    for head, start, size in zip(heads[mixed_up].tolist(), starts[sizes > 2][mixed_up].tolist(), big[mixed_up].tolist()):
        rows = order[start : start + size]
        groups = blind_trie([r.tobytes() for r in rest[head : head + size].astype(">u8")])
        order[start : start + size] = rows[np.concatenate([np.array(g) for g in groups])]
        new[start + np.cumsum([len(g) for g in groups[:-1]])] = True
    return order, new


def covered(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to): the stretches of each context that lie in a window which a context of a smaller doc holds."""
    if not len(contexts):
        return (np.empty(0, np.int64),) * 3
    sizes = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    count = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(contexts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(np.cumsum(sizes) - sizes, count) + at
    eight = np.lib.stride_tricks.sliding_window_view(joined, 8)
    words = np.empty((len(place), -(-LENGTH // 8)), np.uint64)
    for w in range(words.shape[1]):
        words[:, w] = np.ascontiguousarray(eight[place + 8 * w]).view(">u8")[:, 0]
    words[:, -1] >>= np.uint64(8 * (-LENGTH % 8))
    order, new = deep_shallow(words)
    starts = np.flatnonzero(new)
    first = np.minimum.reduceat(docs[of[order]], starts)
    hit = np.zeros(len(of), bool)
    hit[order] = docs[of[order]] > np.repeat(first, np.diff(np.append(starts, len(order))))
    place = np.flatnonzero(hit)
    if not len(place):
        return (np.empty(0, np.int64),) * 3
    run = np.append(True, (np.diff(place) != 1) | (of[place[1:]] != of[place[:-1]]))
    heads, tails = place[run], place[np.append(run[1:], True)]
    return of[heads], at[heads], at[tails] + LENGTH


NOTE = "g long, doc_id long, t long, a long, b long"


def _text_of(rows: pd.DataFrame):
    """(doc_id, t, text) of a group's rows, in the order of doc_id."""
    rows = rows.dropna(subset=["doc_id"]).sort_values(["doc_id", "t"])
    return zip(rows["doc_id"].astype("int64").tolist(), rows["t"].tolist(), rows["text"].tolist())


def _copies(notes: pd.DataFrame) -> set:
    whole = notes[notes["b"] == -1]
    return set(zip(whole["doc_id"].tolist(), whole["t"].tolist()))


def _anchors_of_group(texts: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """A row for each anchor of a group's texts: its hash, and whether two of them hold it."""
    skip, found, g = _copies(notes), [np.empty(0, np.uint64)], 0
    if len(texts):
        g = int(texts["g"].iloc[0])
    for doc, t, text in _text_of(texts):
        if len(text) >= LENGTH and (doc, t) not in skip:
            h = gram_hashes(np.frombuffer(text, np.uint8))
            found.append(np.unique(h[np.unique(window_anchors(h))]))
    anchors, counts = np.unique(np.concatenate(found), return_counts=True)
    return pd.DataFrame({"anchor": anchors.view(np.int64), "g": np.full(len(anchors), g), "many": counts > 1})


def _contexts_of_group(texts: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """Contexts of a group's texts around the anchors in notes (b = -2), or, where the group itself settles one, what it covers."""
    skip, out, first = _copies(notes), [], {}
    wanted = np.sort(notes.loc[notes["b"] == -2, "a"].to_numpy(np.int64).view(np.uint64))
    g = int(texts["g"].iloc[0]) if len(texts) else 0
    for doc, t, text in _text_of(texts):
        if len(text) < LENGTH or (doc, t) in skip or not len(wanted):
            continue
        h = gram_hashes(np.frombuffer(text, np.uint8))
        place = window_anchors(h)
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        tails = np.append(heads[1:], len(place)) + LENGTH - 1
        leads = place[heads] - heads
        own = h[place[heads]]
        use = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
        for anchor, a, b, lead in zip(own[use].view(np.int64).tolist(), heads[use].tolist(), tails[use].tolist(), leads[use].tolist()):
            context = text[a:b]
            settled = first.setdefault(context, doc) < doc
            out.append((g, doc, t, a, b, anchor, lead, None if settled else context))
    return pd.DataFrame(out, columns=["g", "doc_id", "t", "a", "b", "anchor", "lead", "context"])


def _beside(rows: pd.DataFrame) -> np.ndarray:
    """Which contexts may share a window with another one of their anchor: a window reaches HALF bytes or more beyond the
    anchor on one side, so two that share it agree there."""
    n = len(rows)
    lead, sizes = rows["lead"].to_numpy(np.int64), rows["context"].map(len).to_numpy(np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(rows["context"].tolist()) + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(joined, 8)
    anchor, out = rows["anchor"].to_numpy(np.int64).view(np.uint64), np.zeros(n, bool)
    for side, first in ((lead >= HALF, starts + lead - HALF), (sizes - lead - GRAM >= HALF, starts + lead + GRAM)):
        at = np.flatnonzero(side)
        key = anchor[at]
        for k in sorted({*range(0, HALF - 7, 8), HALF - 8}):
            key = mixed(key * np.uint64(BASE) + np.ascontiguousarray(eight[first[at] + k]).view(np.uint64)[:, 0])
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[at[counts[inverse] > 1]] = True
    return out


def _sorted_contexts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[_beside(rows)]
    of, low, high = covered(rows["context"].tolist(), rows["doc_id"].to_numpy(np.int64))
    rows = rows.iloc[of]
    return pd.DataFrame({"g": rows["g"], "doc_id": rows["doc_id"], "t": rows["t"], "a": rows["a"] + low, "b": rows["a"] + high})


def _cut_group(texts: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    """A group's rows with what is left of their texts."""
    skip, cuts, out = _copies(notes), {}, []
    for doc, t, a, b in notes.loc[notes["b"] > 0, ["doc_id", "t", "a", "b"]].itertuples(index=False):
        cuts.setdefault((doc, t), []).append((a, b))
    for doc, t, text in zip(texts["doc_id"].tolist(), texts["t"].tolist(), texts["text"].tolist()):
        doc = None if pd.isna(doc) else int(doc)
        n = len(text)
        own = [(0, n)] if (doc, t) in skip and n else sorted(cuts.get((doc, t), ()))
        kept, spans, removed, at, end = [], 0, 0, 0, -1
        for a, b in own:
            if a > end:  # a new run; a touching one goes on
                kept.append(text[at:a])
                spans, removed, at = spans + 1, removed + b - a, b
                end = b
            elif b > end:
                removed, at, end = removed + b - end, b, b
        kept.append(text[at:])
        out.append((doc, n, removed, spans, b"".join(kept)))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, notes): the rows of docs in groups, and notes for them: b = -1 marks a copy, others what to remove."""
    spark = docs.sparkSession
    tell_workers(spark)
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = raw.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, total // GROUP)
    texts = raw.withColumn("t", F.xxhash64("text")).withColumn("g", F.pmod(F.xxhash64("doc_id", "t"), F.lit(groups)))
    with_id = texts.where("doc_id is not null").select("g", "doc_id", "t", F.octet_length("text").alias("n"), F.xxhash64(F.lit(1), "text").alias("u"))
    narrow = written(with_id.where(F.col("n") >= LENGTH))
    least = narrow.groupBy("t", "u", "n").agg(F.min("doc_id").alias("least"))
    copies = written(narrow.join(least, ["t", "u", "n"]).where("doc_id > least").select("g", "doc_id", "t", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))

    def grouped(notes, function, schema):
        return texts.groupBy("g").cogroup(notes.groupBy("g")).applyInPandas(function, schema)

    anchors = grouped(copies, _anchors_of_group, "anchor long, g long, many boolean")
    by_anchor = Window.partitionBy("anchor")
    shared = written(anchors.withColumn("n", F.count("*").over(by_anchor)).withColumn("m", F.max("many").over(by_anchor)).where("n > 1 or m").select("g", "anchor"))
    asked = copies.unionByName(shared.select("g", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("t"), F.col("anchor").alias("a"), F.lit(-2).cast("long").alias("b")))
    found = written(grouped(asked, _contexts_of_group, NOTE + ", anchor long, lead long, context binary"))
    local = found.where("context is null").select("g", "doc_id", "t", "a", "b")
    equal = found.where("context is not null").withColumn("least", F.min("doc_id").over(Window.partitionBy("context")))
    equal = written(equal)
    whole = equal.where("doc_id > least").select("g", "doc_id", "t", "a", "b")
    rest = equal.where("doc_id = least").drop("least")
    sizes = rest.groupBy("anchor").agg(F.count("*").alias("n"))
    rest = written(rest.join(sizes.where("n > 1"), "anchor"))
    few = rest.where(F.col("n") <= MANY)
    buckets = max(1, few.count() // SORTED + 1)
    in_order = few.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).select("bucket", "g", "doc_id", "t", "a", "anchor", "lead", "context").groupBy("bucket").applyInPandas(_sorted_contexts, NOTE)
    windows = rest.where(F.col("n") > MANY).select("g", "doc_id", "t", "a", "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("i"))
    windows = windows.select("g", "doc_id", "t", (F.col("a") + F.col("i")).alias("a"), F.col("context").substr(F.col("i") + 1, F.lit(LENGTH)).alias("w"))
    least = windows.groupBy("w").agg(F.min("doc_id").alias("least"))
    spread = windows.join(least, "w").where("doc_id > least").select("g", "doc_id", "t", "a", (F.col("a") + LENGTH).alias("b"))
    notes = copies.unionByName(local).unionByName(whole).unionByName(in_order).unionByName(spread)
    return texts, written(notes)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs; kept holds the remaining bytes."""
    texts, notes = removals(docs)
    cut = texts.groupBy("g").cogroup(notes.groupBy("g")).applyInPandas(_cut_group, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    left = without_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w JOIN f USING (s) WHERE doc_id > first),
u AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM u GROUP BY 1, 2),
k AS (
  SELECT doc_id, a, substr(h, 2 * p + 1, 2 * (a - p)) AS piece FROM (
    SELECT doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p
    FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d) JOIN d USING (doc_id))),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS kept FROM k GROUP BY 1),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
