"""Named queries over the star-schema tables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from . import clusters, conjoint, customers, discriminant, lines, positioning, regression

    merged: dict[str, Query] = {}
    for module in (lines, customers, clusters, regression, discriminant, conjoint, positioning):
        overlap = merged.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"query names used twice: {sorted(overlap)}")
        merged.update(module.QUERIES)
    return merged


def all_sql() -> dict[str, str]:
    from . import clusters, conjoint, customers, discriminant, lines, positioning, regression

    merged: dict[str, str] = {}
    for module in (lines, customers, clusters, regression, discriminant, conjoint, positioning):
        merged.update(module.SQL)
    return merged
