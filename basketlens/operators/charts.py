"""Aggregates behind the charts: histograms, value counts, ordered bars, facet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import currency_label, percent_label, ratio
from .rank import running


def fixed_count_histogram(df: DataFrame, column: str, bins: int = 35) -> DataFrame:
    """Bins of equal width centred on min + i*width, right-closed; every bin is present."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / (bins - 1))
    placed = x.crossJoin(F.broadcast(span)).select(
        F.least(F.greatest(F.ceil(F.coalesce(ratio(F.col("x") - F.col("lo"), F.col("w")), F.lit(0.0)) + 0.5), F.lit(1)),
                F.lit(bins)).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("lo", "w", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1.5) * F.col("w")).alias("x_min"),
        (F.col("lo") + (F.col("bin") - 0.5) * F.col("w")).alias("x_max"),
        F.coalesce("n", F.lit(0)).alias("n"),
    ).orderBy("bin")


def fixed_width_histogram(
    df: DataFrame, column: str, width: float, boundary: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Right-closed bins of a given width; occupied bins only.

    Without a boundary the bins are centred on multiples of the width. A value on the lowest
    edge joins the first bin. Groups share one grid.
    """
    edge = width / 2 if boundary is None else boundary
    x = df.select(*by, F.col(column).cast("double").alias("x")).where("x is not null")
    origin = x.agg((F.lit(edge) + F.floor((F.min("x") - edge) / width) * width).alias("origin"))
    index = F.greatest(F.ceil((F.col("x") - F.col("origin")) / width), F.lit(1))
    return (
        x.crossJoin(F.broadcast(origin))
        .groupBy(*by, (F.col("origin") + (index - 1) * width).alias("x_min"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("x_max", F.col("x_min") + width)
        .select(*by, "x_min", "x_max", "n")
    )


def ordered_bars(table: DataFrame, category: str, value: str, label: Column | None = None) -> DataFrame:
    """Bars of a result table in ascending order of value, with the order as a column."""
    text = label if label is not None else F.col(value).cast("string")
    bars = table.select(F.col(category).alias("Category"), F.col(value).alias("Value"), text.alias("Label"))
    return running(bars, [], ["Value", "Category"], F.lit(1)).withColumnRenamed("cum", "SortOrder").drop("n")


def currency_bars(table: DataFrame, category: str, value: str) -> DataFrame:
    return ordered_bars(table, category, value, currency_label(F.col(value)))


def percent_bars(table: DataFrame, category: str, value: str) -> DataFrame:
    return ordered_bars(table, category, value, percent_label(F.col(value)))


def count_share_bars(table: DataFrame, category: str, count: str, share: str) -> DataFrame:
    """Bars labelled 'n (share)'."""
    label = F.concat(F.col(count).cast("string"), F.lit(" ("), percent_label(F.col(share)), F.lit(")"))
    return ordered_bars(table, category, count, label)


def bubbles(profile: DataFrame, cluster: str) -> DataFrame:
    """Average recency against average frequency, sized by customers."""
    return profile.select(
        F.col(cluster).alias("Cluster"), "Avg_Recency", "Avg_Frequency", "Customers",
        F.concat(F.lit("C"), F.col(cluster).cast("string")).alias("Label"),
    )


def facets(part_worths: DataFrame, value: str, attributes: Sequence[str], label: bool = False) -> DataFrame:
    """Level bars per attribute: attribute position as given, levels in ascending order of value."""
    position = F.array_position(F.array(*[F.lit(a) for a in attributes]), F.col("Attribute"))
    levels = W.partitionBy("Attribute").orderBy(F.col(value), F.col("Level"))
    out = part_worths.where(F.col("Attribute").isin(list(attributes))).select(
        "Attribute", "Level", value, position.alias("AttributeOrder"), F.row_number().over(levels).alias("LevelOrder"))
    return out.withColumn("Label", currency_label(F.col(value), 2)) if label else out
