"""Exact top-k search by inner product with statistics of segments at several resolutions.

Vectors are turned into integers floor(256 * x). With segments of length L, means a and b and deviations s and t, an inner
product is at most the sum over segments of L * (a * b + s * t) (Cauchy-Schwarz on what departs from the means), which for given
norms is the lower bound of the distance. In a block of queries and a block of rows the bounds are taken from one segment to
many: each resolution keeps the pairs whose bound can still reach the query's k-th best score so far, and only survivors are
multiplied out, exactly, in integers. Blocks are of bounded size, every query block meets every row block in a task of its own,
and of each such pair only k rows a query go on.

Rows whose id or vector is null, and vectors with a null or non-finite component, take no part. Vectors are compared with those
of their own length; empty ones have score 0 with each other. A query's own id is no candidate; rows that repeat an id are
candidates each, rows that repeat a query ask once. Ties go to the smaller id. Scores beyond 64 bits are cut to them. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import table, tell_workers

SCALE, RESOLUTIONS = 256, (1, 4, 16)
ROW_BLOCK, QUERY_BLOCK, PAIRS = 2048, 512, 100_000


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """[vector, 2 * parts]: means and deviations of the segments, scaled so that a dot product of two rows is the bound."""
    out = []
    for piece in np.array_split(x, parts, 1):
        n = piece.shape[1]
        if n:
            mean = piece.mean(1)
            out += [mean * np.sqrt(n), np.sqrt(((piece - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def search(q: np.ndarray, x: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of pairs that hold every query's k best rows; `same` marks pairs that don't count. Integers in floats."""
    exact = len(q) and (np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**52)
    alive, floor = ~same, np.full(len(q), -np.inf)
    if exact:
        for parts in RESOLUTIONS:
            if parts > max(1, q.shape[1]):
                break
            bound = segments(q, parts) @ segments(x, parts).T
            bound = np.where(alive, bound + 1e-6 * np.abs(bound) + 0.5, -np.inf)
            take = min(k, len(x))
            best = np.argpartition(-bound, take - 1, 1)[:, :take]  # multiplied out first, for a k-th best score to prune by
            scores = np.einsum("ijk,ik->ij", x[best], q)
            scores[~np.take_along_axis(alive, best, 1)] = -np.inf
            if take == k:
                floor = np.maximum(floor, scores.min(1))
            alive &= bound >= floor[:, None]
    i, j = np.nonzero(alive)
    if exact:
        score = np.concatenate([(q[i[a : a + PAIRS]] * x[j[a : a + PAIRS]]).sum(1) for a in range(0, len(i), PAIRS)] or [np.empty(0)])
        return i, j, score.astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(q[a], x[b])) for a, b in zip(i, j)]
    return i, j, np.array([min(max(s, -(2**63)), 2**63 - 1) for s in big], np.int64)


def _integers(rows: DataFrame) -> DataFrame:
    """(id, d, v) of the rows that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    return good.select(F.col("vec_id").alias("id"), F.size(v).alias("d"), v.alias("v"))


def top_k(rows: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every row for which `asks` holds."""
    tell_workers(rows.sparkSession)
    own = rows.select("vec_id", "embedding", asks.alias("asks"))
    whole = _integers(own)
    ask = _integers(own.where("asks")).distinct()
    n, m = whole.count(), ask.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    x = whole.withColumn("r", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    a = ask.withColumn("q", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def meet(query: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(query) and len(row):
            q, x = (np.floor(SCALE * np.array(f["v"].tolist(), np.float64)).reshape(len(f), -1) for f in (query, row))
            qi, xi = query["id"].to_numpy(), row["id"].to_numpy()
            i, j, score = search(q, x, qi[:, None] == xi[None], k)
            order = np.lexsort((xi[j], ~score, i))  # ~ turns the order of integers round without overflow
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            good = rank < k
            parts = [pd.DataFrame({"query_id": qi[i[good]], "vec_id": xi[j[good]], "score": score[good]})]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ("d", "r", "q")
    found = a.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
