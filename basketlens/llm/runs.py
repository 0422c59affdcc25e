"""Periodic runs of words by internal pattern matching: stretches whose smallest period fits into them four times or more.

Words are numbered inside their document and a document ends with a number of its own, so that no block of words that occurs
twice leaves its document. For many documents at once

1. prefix doubling ranks the blocks of 1, 2, 4, ... words that start anywhere and ends in the suffix array; a level's ranks are
   kept, since two blocks are equal where their ranks are;
2. a wavelet tree over the suffix array answers range successor: the next occurrence of a block after (or before) a place;
3. a run of period q holds, for the power of two L with q < L <= 2q, a block of L words that starts at a multiple of L and has
   an occurrence exactly q words later or earlier, and none nearer: occurrences that overlap form a progression whose step is
   their smallest period. Every such dyadic block asks for both neighbours, and a step in [L/2, L) is a candidate period;
4. a candidate grows to its whole run by binary lifting over the ranks, to the right and to the left. Different blocks of a run
   grow to the same stretch, which is kept once.

All of it is numpy over slices of documents with about CHUNK bytes; a longer document is a slice of its own. Nothing is sent
between tasks. A null or empty text has no words and no runs. Rows are independent: repeated rows and ids get a result each, a
null doc_id stays null, extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketlens.llm.common import in_chunks, table, tell_workers

#: A run has at least LEAST words and its period at least TIMES times.
LEAST, TIMES = 6, 4
#: Bytes of text that are indexed together.
CHUNK = 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Wavelet:
    """Range counting and selection over an array of numbers: level by level, from the highest bit, zeros go before ones."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels = []
        for bit in reversed(range(bits)):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in [left, right) are smaller than x."""
        total = np.zeros(len(x), np.int64)
        for bit, before in self.levels:
            l0, r0, zeros = before[left], before[right], before[-1]
            one = (x >> bit) & 1 == 1
            total += np.where(one, r0 - l0, 0)
            left = np.where(one, zeros + left - l0, l0)
            right = np.where(one, zeros + right - r0, r0)
        return total

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) in [left, right)."""
        out = np.zeros(len(k), np.int64)
        for bit, before in self.levels:
            l0, r0, zeros = before[left], before[right], before[-1]
            one = k >= r0 - l0
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - (r0 - l0), k)
            left = np.where(one, zeros + left - l0, l0)
            right = np.where(one, zeros + right - r0, r0)
        return out


def ranked(s: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Prefix doubling over numbers 0, 1, ... in which every document's last one occurs once. For blocks of 1, 2, 4, ... numbers at
    every place: where blocks equal to it begin in the suffix array, and how many they are; then the suffix array."""
    n, width = len(s), 1
    sizes = np.bincount(s)
    rank, size = (np.cumsum(sizes) - sizes)[s], sizes[s]
    ranks, counts = [rank], [size]
    while len(active := np.flatnonzero(size > 1)):
        # a block that occurs twice holds no end of a document: the place behind it exists
        key = rank[active] * n + rank[active + width]
        order = np.argsort(key)
        key, at = key[order], active[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(first, len(key)))
        old = rank[at]
        head = np.concatenate([[True], old[1:] != old[:-1]])
        group = np.maximum.accumulate(np.where(head, np.arange(len(old)), 0))
        rank, size = rank.copy(), np.ones(n, np.int64)
        rank[at] = np.repeat(old[first] + first - group[first], many)
        size[at] = np.repeat(many, many)
        ranks.append(rank)
        counts.append(size)
        width *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return ranks, counts, suffixes


def _agree(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers agree from places i and j on, and how many before them (i < j)."""
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for level in reversed(range(len(ranks))):
        rank = ranks[level]
        ahead += (rank[i + ahead] == rank[j + ahead]).astype(np.int64) << level
        a = i - back - (1 << level)
        b = np.where(a >= 0, j - back - (1 << level), 0)
        back += ((a >= 0) & (rank[np.maximum(a, 0)] == rank[b])).astype(np.int64) << level
    return ahead, back


def find(s: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period. s as for `ranked`; local: places inside the document."""
    ranks, sizes, suffixes = ranked(s)
    none = np.empty((0, 3), np.int64)
    if len(ranks) < 2:
        return none
    # only suffixes whose first two words occur again can be asked for
    kept = sizes[1][suffixes] > 1
    place = np.cumsum(kept) - kept
    tree = Wavelet(local[suffixes[kept]], max(1, int(local.max()).bit_length()))
    found = []
    for level in range(1, len(ranks)):
        length = 1 << level
        at = np.flatnonzero((sizes[level] > 1) & (local & (length - 1) == 0))
        left, x = place[ranks[level][at]], local[at]
        right = left + sizes[level][at]
        before = tree.below(left, right, x)
        for ask, k, way in ((before + 1 < right - left, before + 1, 1), (before > 0, before - 1, -1)):
            step = way * (tree.smallest(left[ask], right[ask], k[ask]) - x[ask])
            near = (step >= length // 2) & (step < length)
            found.append(np.stack([at[ask][near] - (step[near] if way < 0 else 0), step[near]]))
    i, q = np.concatenate(found, axis=1)
    if not len(i):
        return none
    ahead, back = _agree(ranks, i, i + q)
    runs = np.stack([i - back, back + ahead + q, q], axis=1)
    return np.unique(runs[runs[:, 1] >= np.maximum(LEAST, TIMES * q)], axis=0)


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words: rows (start, length, period) by start, then period."""
    number = count()
    parts, local = [], []
    for words in texts:
        ids = defaultdict(number.__next__)
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([next(number)], np.int64))
        local.append(np.arange(len(words) + 1))
    if not texts:
        return []
    runs = find(np.concatenate(parts), np.concatenate(local))
    ends = np.cumsum([len(x) for x in local])
    cuts = np.searchsorted(runs[:, 0], ends)
    runs[:, 0] -= np.repeat(ends - [len(x) for x in local], np.diff(cuts, prepend=0))
    return np.split(runs, cuts[:-1])


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: all it holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def looped(words: list[bytes], h: int | None) -> list[bytes]:
    """The words, from a place on in a loop where the number h ends in 0: see the contract of `op13_runs`."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def periodic_runs(docs: DataFrame, number: Column | None = None,
                  change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs: array of (start, length, period), collapsed: the text's words without repeats, joined by one space) for
    every row. `change` may alter the words of a row first; it is given the value of the column `number`."""
    tell_workers(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       (F.lit(None) if number is None else number).cast("long").alias("number"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, numbers, texts = 0, batch["number"].to_pylist(), batch["text"].to_pylist()
            for part in in_chunks(list(zip(texts, numbers)), lambda x: len(x[0]), CHUNK):
                words = [change(t.split(), h) if change else t.split() for t, h in part]
                runs = runs_of(words)
                flat = np.concatenate(runs)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                yield pa.record_batch([
                    batch["doc_id"].slice(start, len(part)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(RUN))),
                    pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs)], pa.binary()),
                ], names=["doc_id", "runs", "collapsed"])
                start += len(part)

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(
        search, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic_runs(table(spark, folder, "documents"), number, looped)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
