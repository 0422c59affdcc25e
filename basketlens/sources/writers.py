"""Sinks for the result tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove

MANIFEST = "manifest.json"


def write_csv(df: DataFrame, path: str, single_file: bool = False, quote_text: bool = False) -> None:
    """CSV with header; missing values written as ``NA``. ``single_file`` is for k-row report tables.

    ``quote_text`` puts every name and text value in quotes and leaves numbers and ``NA`` bare.
    """
    options = {"header": True, "nullValue": "NA", "escape": '"'}
    if quote_text:
        quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        df = df.select(*[
            (quoted(F.col(f"`{n}`")) if t == "string" else F.col(f"`{n}`")).alias('"' + n.replace('"', '""') + '"')
            for n, t in df.dtypes])
        options |= {"quote": "\u0000", "escapeQuotes": False}
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**options).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    keys = list(partition_by)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv", report_tables: Iterable[str] = ()) -> list[str]:
    """Write every named table under ``folder``; returns the paths."""
    small = set(report_tables)
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if fmt == "csv":
            write_csv(df, path, single_file=name in small)
        else:
            write_parquet(df, path)
        paths.append(path)
    return paths


def _store(spark: SparkSession, folder: str):
    """(Java's path class, a file context and a file system for a folder)."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    place = hadoop.Path(folder)
    system = place.getFileSystem(conf)
    return hadoop, hadoop.FileContext.getFileContext(system.makeQualified(place).toUri(), conf), system


def published_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Where the tables of the published set are, by name; none if nothing was published."""
    hadoop, _, system = _store(spark, folder)
    if not system.exists(hadoop.Path(f"{folder}/{MANIFEST}")):
        return {}
    text = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0]
    return {name: f"{folder}/{path}" for name, path in json.loads(text).items()}


def publish_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv", report_tables: Iterable[str] = ()) -> list[str]:
    """Writes all tables as one set, which replaces the set published before as a whole; returns the paths.

    The tables are staged under a folder of their own. When all of them stand, a manifest that names them is moved into place, which
    is a single step; readers find the tables by ``published_tables``. If a table fails, what was staged is removed and the old set
    stays. The set before the new one is kept for readers that still use it, older ones are removed.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"
    before = {path.rsplit("/", 2)[-2] for path in published_tables(spark, folder).values()}
    hadoop, context, system = _store(spark, folder)
    draft = hadoop.Path(f"{folder}/_{version}.json")
    try:
        write_tables(tables, f"{folder}/{version}", fmt, report_tables)
        out = system.create(draft, True)
        out.write(bytearray(json.dumps({name: f"{version}/{name}" for name in tables}).encode()))
        out.close()
        over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        context.rename(draft, hadoop.Path(f"{folder}/{MANIFEST}"), over)
    except BaseException:
        remove(spark, f"{folder}/_{version}.json")
        remove(spark, f"{folder}/{version}")
        raise
    for status in system.listStatus(hadoop.Path(folder)):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in before | {version}:
            remove(spark, f"{folder}/{name}")
    return [f"{folder}/{version}/{name}" for name in tables]
