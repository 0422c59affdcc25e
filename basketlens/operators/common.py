"""Join helpers used by several jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                 small_right: bool = False) -> DataFrame:
    """Null-safe equi-join on ``keys``; a one-row cross join when there are none.

    ``small_right`` asks for a broadcast. Callers set it only for tables whose row count is
    fixed by parameters (levels, segments, clusters), not by the data volume.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    other = F.broadcast(renamed) if small_right else renamed
    return left.join(other, condition, how).drop(*[f"__{k}" for k in keys])
