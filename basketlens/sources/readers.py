"""Readers. CSV files keep blank text as blank; only ``NA`` is missing."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import exact_quantiles
from . import schemas


CORRUPT = "_corrupt_record"
QUARANTINE = "file string, problem string, record string"


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by the columns of their own header line, in its order.

    One job finds the first line of every file; the driver gets a line per file, as it does for any listing of them.
    """
    place = F.col("_metadata")
    lines = spark.read.text(path).select(
        place["file_path"].alias("file"), place["file_block_start"].alias("start"), "value",
        F.monotonically_increasing_id().alias("row")).where("start = 0")
    found: dict[tuple[str, ...], list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "row").alias("header")).orderBy("file").collect():
        found.setdefault(tuple(next(csv.reader([r["header"].removeprefix("\ufeff")]))), []).append(r["file"])
    return found


def _typed(cell: Column, kind: T.DataType) -> Column:
    """A text cell as its declared type, null where it is none."""
    if isinstance(kind, T.StringType):
        return cell
    bare = F.nullif(F.trim(cell), F.lit(""))
    if isinstance(kind, T.DateType):
        return F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")).cast("date")
    return bare.try_cast(kind)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of CSV files: the declared columns that the files have, ``__file``, ``__problem`` and ``__record``.

    Every file is read by its own header. ``__problem`` names what is wrong with a row, or is null: a number of cells other than
    that of the header, or a cell that is not of its column's declared type. An empty cell of a number or date is no problem.
    """
    parts = []
    for header, files in csv_layouts(spark, path).items():
        twice = sorted({c for c in header if header.count(c) > 1})
        if twice:
            raise ValueError(f"columns {twice} appear twice in {files[0]}")
        text = T.StructType([T.StructField(c, T.StringType(), True) for c in (*header, CORRUPT)])
        # without pruning: cells are counted in every row, whatever columns a query needs
        rows = spark.read.schema(text).options(
            header=True, nullValue="NA", emptyValue="", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False,
            escape='"').csv(files)
        cells = {f.name: F.col(f"`{f.name}`") for f in schema.fields if f.name in header}
        kinds = {f.name: f.dataType for f in schema.fields}
        wrong = [
            F.when((F.trim(c) != "") & _typed(c, kinds[n]).isNull(), F.concat(F.lit(f"{n} is not {kinds[n].simpleString()}: "), c))
            for n, c in cells.items() if not isinstance(kinds[n], T.StringType)]
        problem = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), F.lit(f"not {len(header)} cells")), *wrong)
        record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header])))
        parts.append(rows.select(
            *[_typed(c, kinds[n]).alias(n) for n, c in cells.items()],
            F.col("_metadata")["file_path"].alias("__file"), problem.alias("__problem"), F.when(problem.isNotNull(), record).alias("__record")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in ("__file", "__problem", "__record")]]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, quarantine: str | None = None) -> DataFrame:
    """Typed CSV scan by the header of each file, restricted to the declared columns that the files have.

    ``NA`` is null and an empty text field stays an empty string; an empty number is null. A row whose cells do not fit fails the
    job with its file and text; with ``quarantine`` such rows are written to that folder (file, problem, record) and the others
    come back. Either way no value turns into a null unseen.
    """
    rows = scan_csv(spark, path, schema)
    if quarantine is not None:
        bad = rows.where(F.col("__problem").isNotNull()).select(
            F.col("__file").alias("file"), F.col("__problem").alias("problem"), F.col("__record").alias("record"))
        bad.write.mode("overwrite").parquet(quarantine)
        rows = rows.where(F.col("__problem").isNull())
    else:
        said = F.concat(F.col("__file"), F.lit(": "), F.col("__problem"), F.lit(": "), F.coalesce("__record", F.lit("")))
        rows = rows.where(F.when(F.col("__problem").isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    names = [f.name for f in schema.fields if f.name in rows.columns]
    return rows.select(*names).withColumnsRenamed({k: v for k, v in schemas.MISSPELT_COLUMNS.items() if k in names})


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRANSACTIONS)


def read_prospects(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PROSPECTS)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RATINGS)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PROFILES)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRODUCTS)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a star-schema folder, under its declared schema (no footer inference job)."""
    reader = spark.read.schema(schemas.STAR_TABLES[name]) if name in schemas.STAR_TABLES else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def describe_table(df: DataFrame) -> DataFrame:
    """Structure check: row and column counts, names and types, one row per column."""
    fields = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, type string",
    )
    size = df.agg(F.count(F.lit(1)).alias("row_count"))
    return fields.crossJoin(F.broadcast(size)).withColumn("column_count", F.lit(len(df.columns)))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, quartiles, mean, max and sample deviation per numeric column, one row each."""
    stats = {"min": F.min, "mean": F.avg, "max": F.max, "sd": F.stddev_samp}
    wide = df.agg(*[
        F.struct(*[f(F.col(c).cast("double")).alias(k) for k, f in stats.items()]).alias(c) for c in columns
    ])
    rows = [F.struct(F.lit(c).alias("Variable"), *[F.col(c)[k].alias(k) for k in stats]) for c in columns]
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("Variable").agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(k) for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return wide.select(F.inline(F.array(*rows))).join(quartiles, "Variable", "left")
