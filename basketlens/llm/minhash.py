"""MinHash near-dedup with min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature of 2p values
costs p evaluations. Rows of the signature are banded; documents that agree on a band are candidates, and candidates are linked
by the exact Jaccard similarity of their full shingle sets.

Documents with equal sets are one class from the start and only the class's smallest doc_id goes on. Within a band's group
nobody meets everybody: in each round every member whose component differs from that of a centre of the group is compared
with it (other members each round), and components are joined; groups that hold one component are done. What is left is
completed without loss: small groups by all their pairs across components, the members of large ones by the prefix filter,
which lets only those pairs meet across components that share one of their rarest shingles, and early enough, as every pair
over the threshold does.

Bands of 5 values, 28 of them: a pair at the threshold 0.85 is missed with probability (1 - 0.85^5)^28 < 1e-7, at 0.80 < 2e-5.

A document without words, or of null text, has the empty set: it is linked with nothing. Rows without doc_id are judged like
others but cannot be named: they never represent a class and are always kept, with a null component. Rows that repeat a doc_id meet equal
texts, but only one of their texts (the one whose set has the smallest hash) is compared further. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import components, in_chunks, table, tell_workers, written
from basketlens.llm.words import ODD, lower_words, mixed, shingles

ROWS, BANDS, WORDS = 5, 28, 5
PERMUTATIONS = ROWS * BANDS // 2
#: Centres that groups are compared with, round by round; then groups of up to FEW members are completed by their own pairs.
CENTRES, FEW = (2, 1), 16
#: Bytes of text whose signatures are computed at once.
CHUNK = 4_000_000
_rng = np.random.Generator(np.random.PCG64(20240229))
MULTIPLIERS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, 2 * permutation and + 1]: minimum and maximum of every set under every permutation; sets must not be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for p, a in enumerate(MULTIPLIERS):
        x = joined * a
        x ^= x >> np.uint64(29)  # a bijection too; without it order would follow the low bits of the hash only by the product
        out[:, 2 * p] = np.minimum.reduceat(x, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """[set, band]: a hash of each band's values and of the band's number."""
    bands = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    """A 128-bit hash of a set; empty for the empty set."""
    return np.array([np.bitwise_xor.reduce(mixed(s)), np.add.reduce(mixed(s ^ ODD))]).tobytes() if len(s) else b""


def described(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, t, n, key, bands): a hash of the text, set size, a 128-bit hash of the set (null if empty) and its band keys."""
    tell_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in in_chunks(list(zip(batch["doc_id"], batch["t"], batch["text"])), lambda r: len(r[2]), CHUNK):
                sets = [shingles(lower_words(r[2]), k) for r in part]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, bands = [None] * len(part), [None] * len(part)
                if full:
                    found = band_keys(signatures([sets[i] for i in full]))
                    for i, b in zip(full, found):
                        keys[i], bands[i] = set_key(sets[i]), b
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in part], "Int64"), "t": [r[1] for r in part], "n": [len(s) for s in sets], "key": keys, "bands": bands})

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInPandas(run, "doc_id long, t long, n long, key binary, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, key, set): shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            sets = [shingles(lower_words(t), k) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "key": list(map(set_key, sets)), "set": [s.tobytes() for s in sets]})

    return texts.mapInPandas(run, "id long, key binary, set binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    a = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(close("x", "y")).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs, and t, the hash of its text."""
    all_rows = written(described(docs, k))
    classes = all_rows.where("key is not null and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = written(classes)
    compared = classes.groupBy("id").agg(F.min(F.struct("key", "n", "bands")).alias("x")).select("id", "x.*")
    banded = compared.select("id", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    groups = written(banded.join(shared.select("band"), "band"))
    members = groups.select("id").distinct().join(compared.select("id", "key"), "id")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sets = _sets(texts.join(members.select("id"), "id"), k).join(members, ["id", "key"]).select("id", "set").dropDuplicates(["id"])
    sets = written(sets)
    found = linked_components(groups, sets, percent)
    label = classes.join(found, "id", "left").select("key", "n", F.coalesce("component", "id").alias("component"))
    rows = all_rows.select("doc_id", "t", "n", "key")
    out = rows.join(label, ["key", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "t",
    )


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each component; rows without doc_id stay, of rows that repeat id and text one stays."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id", F.col("t").alias("__t")).distinct()
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    named = keyed.where("doc_id is not null").join(gone, ["doc_id", "__t"], "left_anti").dropDuplicates(["doc_id", "__t"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def linked_components(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the members of band groups (id, n, band) that have a link."""
    labels = None
    for turn, many in enumerate(CENTRES):
        now = _labelled(groups, labels)
        chosen = [
            F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(i), "id").alias("h"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")))
            for i in range(many)
        ]
        centres = now.groupBy("band").agg(F.array_distinct(F.array(*chosen)).alias("x")).select("band", F.inline("x"))
        labels = _joined(now.join(centres, "band").select("id", "n", "c", "b", "nb", "cb"), sets, percent, labels)
    now = written(_labelled(groups, labels))
    split = now.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("m"), F.count("*").alias("cs")).where("cs > 1")
    now = written(now.join(split.select("band", "m"), "band"))
    few = _across(now.where(F.col("m") <= FEW).drop("m"), "band")
    many = now.where(F.col("m") > FEW).select("id", "n", "c").distinct()
    # what two sets can share from their first common shingle on must reach the overlap that the threshold asks for
    at_most = 1 + F.least(F.col("n") - F.col("rank"), F.col("nb") - F.col("rank_b"))
    enough = at_most * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("nb"))
    return _joined(few.unionByName(_across(_rare_tokens(many, sets, percent), "token", enough)), sets, percent, labels)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with `c`, the component of their id so far."""
    if labels is None:
        return rows.withColumn("c", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _joined(pairs: DataFrame, sets: DataFrame, percent: int, labels: DataFrame | None) -> DataFrame:
    """The components after those of the pairs (id, n, c) and (b, nb, cb) that lie in two components and are close."""
    near = F.lit(100) * F.least("n", "nb") >= F.lit(percent) * F.greatest("n", "nb")  # else the sizes alone forbid it
    pairs = pairs.where((F.col("c") != F.col("cb")) & near)
    links = written(_linked(pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), sets, percent))
    if labels is not None:
        links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(links)


def _across(rows: DataFrame, key: str, also: Column | None = None) -> DataFrame:
    """Pairs that share a key and lie in two components: the members outside the key's largest component, with all others."""
    largest = rows.groupBy(key, "c").agg(F.count("*").alias("k")).groupBy(key).agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("cs"))
    left = rows.join(largest.where("cs > 1").select(key, "main"), key)
    other = {"id": "b", "n": "nb", "c": "cb", "rank": "rank_b"}
    outer = left.where("c <> main").select(F.col(key).alias("key_b"), *(F.col(x).alias(y) for x, y in other.items() if x in rows.columns))
    same = (F.col(key) == F.col("key_b")) & (F.col("c") != F.col("cb"))
    return left.join(outer, same if also is None else same & also).select("id", "n", "c", "b", "nb", "cb")


def _rare_tokens(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, c, token, rank): each member's rarest shingles, as many as two sets over the threshold must share one of (the prefix
    filter, exact for any order that all sets share; here by the number of members that have the shingle)."""

    def each(batches):
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch["set"]]
            size = [len(x) for x in found]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), size), "token": np.concatenate(found) if found else np.empty(0, np.int64)})

    tokens = written(sets.join(members.select("id"), "id").select("id", "set").mapInPandas(each, "id long, token long"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    placed = tokens.join(frequent, "token").withColumn("rank", rank).join(members, "id")
    return placed.where((F.col("rank") <= prefix) & (F.col("df") > 1)).select("id", "n", "c", "token", "rank")


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).drop("t")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
