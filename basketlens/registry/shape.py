"""One column list per query, applied to the Spark result and to the SQL alike.

A list reads ``name:type; name:type``. Types: ``s`` text, ``i`` bigint, ``f`` double rounded
to six places (``f3``: three), ``b`` boolean, ``d`` date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(columns: str) -> list[tuple[str, str, int]]:
    parsed = []
    for item in columns.split(";"):
        name, _, kind = item.strip().rpartition(":")
        parsed.append((name, kind[0], int(kind[1:] or 6)))
    return parsed


_SPARK_TYPES = {"s": "string", "i": "bigint", "b": "boolean", "d": "date"}
_SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "d": "DATE"}


def shape_frame(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind, places in parse(columns):
        c = F.col(f"`{name}`")
        c = F.round(c.cast("double"), places) if kind == "f" else c.cast(_SPARK_TYPES[kind])
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(query: str, columns: str, ctes: str = "") -> str:
    out = []
    for name, kind, places in parse(columns):
        if kind == "f":
            rounded = f'round(CAST("{name}" AS DOUBLE), {places})'
            out.append(f'CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"')
    prefix = f"WITH {ctes}\n" if ctes else ""
    return f"{prefix}SELECT {', '.join(out)}\nFROM ({query}) AS result"


class Book:
    """Collects queries with their column lists and SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, columns: str | None, job: Callable[[SparkSession, str], DataFrame],
            sql: str | None = None, ctes: str = "") -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            result = job(spark, sf)
            return shape_frame(result, columns) if columns else result

        self.queries[name] = run
        if sql:
            if not columns:
                raise ValueError("a query with SQL needs a column list")
            self.sql[name] = shape_sql(sql, columns, ctes)
