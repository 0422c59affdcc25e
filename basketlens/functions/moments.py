"""Means and covariances by distributed sums; only p×p numbers reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import temporary, written


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def product_sums(x: Sequence[Column]) -> Column:
    """Upper triangle of the sums of products as one array-valued aggregate: plain sums, which stay in generated code."""
    return F.array(*[F.sum(x[i] * x[j]) for i, j in pairs(len(x))])


def unpack_symmetric(flat: Sequence[float], p: int) -> np.ndarray:
    """Upper triangle -> full matrix; a missing covariance (single row) counts as zero."""
    full = np.zeros((p, p))
    for value, (i, j) in zip(flat, pairs(p)):
        full[i, j] = full[j, i] = 0.0 if value is None else value
    return full


@dataclass(frozen=True)
class Moments:
    names: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray


def as_doubles(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The named columns as doubles, complete rows only (as least squares drops incomplete ones)."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=list(names))


def collect_moments(df: DataFrame, names: Sequence[str]) -> Moments:
    """Moments over the complete rows, in two passes over a narrow copy of them: the means, then sums of products of what is
    left beside the means."""
    names = list(names)
    spark = df.sparkSession
    with temporary(spark):
        rows = written(as_doubles(df, names))
        first = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean")).first()
        if first["n"] < 2:
            raise ValueError("fewer than two complete rows")
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(names, first["mean"])]
        second = rows.agg(product_sums(x).alias("s"), F.array(*map(F.sum, x)).alias("d")).first()
    mean, n = np.array(first["mean"], dtype=float), first["n"]
    rest = np.array(second["d"], dtype=float)  # what rounding left of the means
    cross = unpack_symmetric(second["s"], len(names)) - np.outer(rest, rest) / n
    return Moments(names, n, mean + rest / n, cross / (n - 1))


def group_moments(rows: DataFrame, group: str, names: Sequence[str], few: bool = False,
                  indicators: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(group, n, mean, cov) per group: its means, joined to its rows again, then plain sums of shifted products.

    Rows are combined map-side both times; the join carries one row per group on its small side, so that a hot group can be
    split. ``rows`` is read twice: write it first. ``few`` asks for a broadcast of the means, for groups that are classes.
    ``indicators`` lists columns of 0 and 1, of which at most one of a list is 1 in a row: their counts are exact without a
    shift, their squares are themselves, and products inside a list are zero.
    """
    family = {c: k for k, members in enumerate(indicators) for c in members}
    shifted = [i for i, c in enumerate(names) if c not in family]
    means = rows.groupBy(F.col(group).alias("__g")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(names[i]).alias(f"__m{i}") for i in shifted])
    # an outer join: every row has its group, and only the means can be the side that is built
    joined = rows.join(F.broadcast(means) if few else means, F.col(group).eqNullSafe(F.col("__g")), "left")
    x = [F.col(c) - F.col(f"__m{i}") if i in shifted else F.col(c) for i, c in enumerate(names)]
    # a group's means are keys beside it: as aggregates they would cost a buffer each
    keys = ["__g", "__n", *[f"__m{i}" for i in shifted]]
    own, zero = {}, set()
    for i, j in pairs(len(names)):
        if names[i] in family and family.get(names[i]) == family.get(names[j]):
            if i != j:
                zero.add((i, j))
        else:
            own[i, j] = F.sum(x[i] * x[j]).alias(f"__s{i}_{j}")
    sums = joined.groupBy(*keys).agg(*own.values(), *[F.sum(c).alias(f"__d{i}") for i, c in enumerate(x)])
    n = F.col("__n").cast("double")
    d = [F.col(f"__d{i}") for i in range(len(names))]
    product = lambda i, j: F.lit(0.0) if (i, j) in zero else F.col(f"__s{i}_{j}") if (i, j) in own else d[i]
    centred = [product(i, j) - d[i] * d[j] / n for i, j in pairs(len(names))]
    # one row has no covariance
    cov = F.array(*[F.when(n > 1, c / F.greatest(n - 1, F.lit(1.0))) for c in centred])
    mean = F.array(*[(F.col(f"__m{i}") if i in shifted else F.lit(0.0)) + d[i] / n for i in range(len(names))])
    return sums.select(F.col("__g").alias(group), F.col("__n").alias("n"), mean.alias("mean"), cov.alias("cov"))


def collect_group_moments(
    df: DataFrame, group: str, names: Sequence[str]
) -> dict[object, Moments]:
    """Moments per class of a model. One row per class reaches the driver."""
    names = list(names)
    with temporary(df.sparkSession):
        rows = written(as_doubles(df, names, keep=[group]).where(F.col(group).isNotNull()))
        found = group_moments(rows, group, names, few=True).orderBy(group).collect()
    return {
        r[group]: Moments(names, r["n"], np.array(r["mean"], dtype=float), unpack_symmetric(r["cov"], len(names)))
        for r in found
    }


def invert_spd(matrix: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Inverse of a covariance-like matrix, scaled to correlations first; names the columns if singular."""
    scale = np.sqrt(np.diag(matrix))
    flat = [n for n, s in zip(names, scale) if not s > 0]
    if flat:
        raise ValueError(f"constant columns: {flat}")
    corr = matrix / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(corr)
    if values[0] < 1e-10:
        guilty = [n for n, w in zip(names, np.abs(vectors[:, 0])) if w > 0.1]
        raise ValueError(f"linearly dependent columns: {guilty}")
    return np.linalg.inv(corr) / np.outer(scale, scale)
