"""What the operators share: table access, shared intermediate tables, dense numbering, connected components."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.session import shared_folder, written

#: Words of a text: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(df: DataFrame, name: str, *order: Column, ranges: list[Column] | None = None) -> DataFrame:
    """df with its rows numbered from 0 in the given order. Rows are range-partitioned (by `ranges`, shorter keys that never go
    against the order, where given) and sorted once and written; only one row count per partition is summed in one place."""
    base, low = f"__{name}", (1 << 33) - 1
    parts = written(
        df.repartitionByRange(*(ranges or order)).sortWithinPartitions(*order).withColumn(base, F.monotonically_increasing_id())
    )
    part = F.shiftright(base, 33).alias("__part")
    counts = parts.groupBy(part).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        parts.withColumn("__part", F.shiftright(base, 33))
        .join(F.broadcast(offsets), "__part")  # a row per partition
        .withColumn(name, F.col("__offset") + F.col(base).bitwiseAND(low))
        .drop("__part", "__offset", base)
    )


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; the component is the smallest id that its links reach. Rounds of large-star and
    small-star hooking, each written to the shared folder, until all edges are stars; never a neighbourhood in one row."""
    e = written(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    )
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lows, "u").select(F.explode(hooked).alias("x")).select("x.u", "x.v")
        e = written(small.where("u <> v").distinct())
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then every v is the smallest id of its component."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return several.unionByName(inner).isEmpty()


def tell_workers(spark: SparkSession) -> None:
    """Lets Python workers that share the driver's disk import this package; on a cluster it is shipped with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def in_chunks(rows: list, size, most: int):
    """Consecutive slices of rows whose sizes add up to about `most`; a larger row is a slice of its own."""
    start = total = 0
    for i, row in enumerate(rows):
        n = size(row)
        if i > start and total + n > most:
            yield rows[start:i]
            start, total = i, 0
        total += n
    if start < len(rows):
        yield rows[start:]
