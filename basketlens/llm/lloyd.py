"""Centroid clustering by dimension-sharded Lloyd iterations over vectors of whole numbers; every result is exact.

Vectors are dealt once into groups of at most ROWS, and a group into column blocks of BLOCK dimensions: (group, block, matrix in
the narrowest whole numbers that hold it), written to the shared folder. A round then is

1. column-block tasks: each computes, for the rows of its matrices, the partial squared distances to the slices of the centroids
   that belong to its block;
2. the blocks of a group are added by key and every row takes the smallest sum (ties: the smaller number);
3. the labels go back to the blocks, a byte or two a row, and every shard sums its own slice by cluster; the sums, as many as
   the centroids have components, are divided on the driver.

A task holds a block or a group at a time, whatever the number of vectors or dimensions. What is broadcast is the centroids,
whose size parameters set.

Vectors that are null, have another number of components than asked for, or hold a null or non-finite one take no part; a
component of 2^27 or more raises an error, since squared distances would leave 64 bits. Rows that repeat count each. Rows without
vec_id are clustered too and start a centroid only if too few others are there. With fewer vectors than centroids there are as many
centroids as vectors; an empty table has an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketlens.llm.common import table, tell_workers, written

#: Vectors of a group, and dimensions of a column block.
ROWS, BLOCK = 1024, 16
#: Components are smaller than this: 4096 of their squared differences fit 64 bits.
LARGEST = 1 << 27
WIDTHS = (np.int8, np.int16, np.int32)


def scaled(vectors: DataFrame, scale: int, dimensions: int, column: str = "embedding") -> DataFrame:
    """(vec_id, x: array<long>) of the vectors that take part: floor(scale * component), component as double."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where((F.size(column) == dimensions) & finite).select("vec_id", F.transform(x, lambda v: v * scale).alias("x"))
    fits = F.forall("x", lambda v: F.abs(v) < LARGEST)
    whole = F.transform("x", lambda v: F.floor(v).cast("long"))
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more"))).alias("x"))


def first_centroids(rows: DataFrame, clusters: int, dimensions: int, salt: str = "1:") -> np.ndarray:
    """The vectors of the smallest sha256(salt, vec_id) in hexadecimal; rows without vec_id come last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(key.asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), dimensions)


def blocks_of(rows: DataFrame, dimensions: int, per_group: int = ROWS, per_block: int = BLOCK) -> DataFrame:
    """Rows dealt into (group, block, ids, data) and written: one row for each column block of a group, and one of block -1 with its
    ids. Groups are numbered by task and place, which the written table fixes."""
    tell_workers(rows.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, dimensions)
            ids = batch["vec_id"].cast(pa.string()).to_pylist()
            for k in range(0, len(x), per_group):
                part = x[k : k + per_group]
                data = [_packed(part[:, c : c + per_block]) for c in range(0, dimensions, per_block)]
                n = len(data) + 1
                yield pa.record_batch([
                    pa.array([group] * n, pa.int64()), pa.array(range(-1, n - 1), pa.int32()),
                    pa.array([ids[k : k + per_group], *[None] * (n - 1)], pa.list_(pa.string())), pa.array([None, *data], pa.binary()),
                ], names=["group", "block", "ids", "data"])
                group += 1

    return written(rows.mapInArrow(deal, "group long, block int, ids array<string>, data binary"))


def _packed(x: np.ndarray) -> bytes:
    """The size of the numbers in bytes, then the numbers row by row."""
    top = max(-int(x.min()) - 1, int(x.max()))
    kind = next((k for k in WIDTHS if top <= np.iinfo(k).max), np.int64)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(-1, columns).astype(np.int64)


def _distances(blocks: DataFrame, centroids: np.ndarray, per_block: int = BLOCK) -> DataFrame:
    """(group, ids, partial) of every shard: squared distances of its rows to the centroids' slices; ids come along."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, block, ids, data in zip(batch["group"], batch["block"], batch["ids"], batch["data"]):
                partial = None
                if block >= 0:
                    own = centroids[:, block * per_block : (block + 1) * per_block]
                    x = _unpacked(data, own.shape[1])
                    partial = np.stack([((x - c) ** 2).sum(1) for c in own], axis=1).tobytes()
                yield pd.DataFrame({"group": [group], "ids": [ids], "partial": [partial]})

    return blocks.mapInPandas(run, "group long, ids array<string>, partial binary")


def _nearest(part: pd.DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    total = sum(np.frombuffer(x, np.int64) for x in part["partial"] if x is not None).reshape(-1, clusters)
    best = total.argmin(1)  # the first of equal ones
    return best, total[np.arange(len(best)), best]


def labelled(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(group, labels): the nearest centroids of a group's rows, from the sums of its blocks' partial distances."""
    clusters = len(centroids)
    kind = np.min_scalar_type(clusters)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": part["group"][:1], "labels": [_nearest(part, clusters)[0].astype(kind).tobytes()]})

    partial = _distances(blocks.where("block >= 0"), centroids).select("group", "partial")
    return partial.groupBy("group").applyInPandas(add, "group long, labels binary")


def moved(blocks: DataFrame, centroids: np.ndarray, per_block: int = BLOCK) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; one without vectors stays."""
    clusters, dimensions = centroids.shape
    kind = np.min_scalar_type(clusters)
    shards = blocks.where("block >= 0").select("group", "block", "data").join(labelled(blocks, centroids), "group")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, data, labels in zip(batch["block"], batch["data"], batch["labels"]):
                x = _unpacked(data, min(per_block, dimensions - block * per_block))
                sums = np.zeros((clusters, x.shape[1]), np.int64)
                label = np.frombuffer(labels, kind).astype(np.int64)
                np.add.at(sums, label, x)
                c, k = np.divmod(np.arange(sums.size), x.shape[1])
                yield pd.DataFrame({"cluster": c, "at": block * per_block + k, "n": np.bincount(label, minlength=clusters)[c], "s": sums.ravel()})

    added = shards.mapInPandas(add, "cluster int, at int, n long, s long").groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in added.where("n > 0").collect():  # a number for each component of the centroids
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def clustered(vectors: DataFrame, clusters: int, scale: int, dimensions: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    rows = scaled(vectors, scale, dimensions)
    kind = dict(vectors.dtypes)["vec_id"]
    blocks = blocks_of(rows, dimensions)
    centroids = first_centroids(rows, clusters, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(blocks, centroids)
    n = len(centroids)

    def last(part: pd.DataFrame) -> pd.DataFrame:
        best, distance = _nearest(part, n)
        ids = next(x for x in part["ids"] if x is not None)
        return pd.DataFrame({"vec_id": list(ids), "cluster": best, "distance": distance})

    out = _distances(blocks, centroids).groupBy("group").applyInPandas(last, "vec_id string, cluster int, distance long")
    return out.withColumn("vec_id", F.col("vec_id").cast(kind)), centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the distances summed over their cluster and over all, and a hash of their centroid. A row per centroid is broadcast."""
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(facts), "cluster")


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows, centroids = clustered(table(spark, folder, "embeddings"), clusters=16, scale=64, dimensions=64, rounds=3)
    return with_inertia(written(rows), centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """DuckDB SQL: vectors as rows of lists, centroids as (cluster, place, component)."""
    parts = ["""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
f AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS k, x FROM v),
c0 AS (SELECT k, x FROM f WHERE k < 16)"""]
    near = """d{i} AS (
  SELECT r, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT))) AS d FROM v, c{i} AS c),
a{i} AS (SELECT r, CAST(split_part(m, ':', 2) AS INTEGER) AS k, CAST(split_part(m, ':', 1) AS BIGINT) AS d
  FROM (SELECT r, min(lpad(CAST(CAST(d AS BIGINT) AS VARCHAR), 19, '0') || ':' || lpad(CAST(k AS VARCHAR), 3, '0')) AS m FROM d{i} GROUP BY r))"""
    move = """s{i} AS (
  SELECT a.k, g.j, CAST(sum(v.x[g.j]) AS HUGEINT) AS s, count(*) AS n
  FROM a{i} AS a JOIN v USING (r), (SELECT unnest(range(1, 65)) AS j) AS g GROUP BY a.k, g.j),
c{j} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} AS c
  LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{i} GROUP BY k) AS m USING (k))"""
    for i in range(4):
        parts.append(near.format(i=i))
        if i < 3:
            parts.append(move.format(i=i, j=i + 1))
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 AS a JOIN v USING (r) JOIN c3 AS c USING (k)"""


SQL = _sql()
