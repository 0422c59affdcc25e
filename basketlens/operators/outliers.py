"""Percentile-based outlier review of transaction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mean_of, ratio
from ..session import written
from .quality import LINE_COLUMNS
from .rank import exact_quantiles, quantile_columns, summarise

THRESHOLDS = (0.99, 0.995, 0.999)


def percentile_thresholds(
    df: DataFrame, columns: Sequence[str] = ("Quantity", "TotalSpend"),
    probs: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """One row per percentile, one column per variable."""
    long = exact_quantiles(df, columns, probs)
    wide = long.groupBy("p").agg(*[F.max(F.when(F.col("Variable") == c, F.col("value"))).alias(c) for c in columns])
    name = F.concat(F.regexp_replace(F.format_string("%.1f", F.col("p") * 100), r"\.0$", ""), F.lit("th percentile"))
    return wide.select(name.alias("Threshold"), *columns).orderBy("Threshold")


def flag_outliers(df: DataFrame) -> DataFrame:
    """Lines above the 99th percentile of quantity or spend, with the 99 and 99.9 flags."""
    cuts = quantile_columns(df, {
        "__q99": ("Quantity", 0.99), "__q999": ("Quantity", 0.999),
        "__s99": ("TotalSpend", 0.99), "__s999": ("TotalSpend", 0.999),
    })
    quantity, spend = F.col("Quantity").cast("double"), F.col("TotalSpend").cast("double")
    flagged = df.crossJoin(F.broadcast(cuts)).withColumns({
        "Quantity_Outlier_99": quantity > F.col("__q99"),
        "Spend_Outlier_99": spend > F.col("__s99"),
        "Quantity_Outlier_999": quantity > F.col("__q999"),
        "Spend_Outlier_999": spend > F.col("__s999"),
    })
    return flagged.where("Quantity_Outlier_99 or Spend_Outlier_99").select(
        *LINE_COLUMNS, "Quantity_Outlier_99", "Spend_Outlier_99", "Quantity_Outlier_999", "Spend_Outlier_999",
    )


def outlier_summary(outliers: DataFrame, lines: DataFrame) -> DataFrame:
    """Size of the flagged set and its share of all sales."""
    total = lines.agg(F.sum("TotalSpend").alias("__all"))
    flagged = outliers.agg(
        F.count(F.lit(1)).alias("Outlier_Rows"),
        F.count_distinct("CustomerID").alias("Unique_Customers"),
        F.sum("TotalSpend").alias("Total_Outlier_Spend"),
    )
    return flagged.crossJoin(F.broadcast(total)).select(
        "Outlier_Rows", "Unique_Customers", "Total_Outlier_Spend",
        ratio(F.col("Total_Outlier_Spend"), F.col("__all")).alias("Share_of_Total_Sales"),
    )


def outlier_by_category(outliers: DataFrame) -> DataFrame:
    return (
        outliers.groupBy("ProductCategory")
        .agg(
            F.count(F.lit(1)).alias("Outlier_Rows"),
            F.sum("TotalSpend").alias("Outlier_Spend"),
            F.max("Quantity").alias("Max_Quantity"),
            F.max("TotalSpend").alias("Max_Line_Spend"),
        )
        .orderBy(F.desc("Outlier_Spend"), "ProductCategory")
    )


def cap_at_percentile(df: DataFrame, column: str, p: float = 0.95) -> DataFrame:
    """Rows at or below the percentile."""
    cut = quantile_columns(df, {"__cap": (column, p)})
    return df.crossJoin(F.broadcast(cut)).where(F.col(column).cast("double") <= F.col("__cap")).drop("__cap")


def trim_percentile(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two percentiles of the whole column, both ends included."""
    cut = quantile_columns(df, {"__low": (column, low), "__high": (column, high)})
    x = F.col(column).cast("double")
    return df.crossJoin(F.broadcast(cut)).where(x.between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def outlier_review(outliers: DataFrame, n: int | None = None) -> DataFrame:
    """The flagged lines, highest spend first; all of them unless ``n`` is given."""
    ranked = outliers.orderBy(F.desc("TotalSpend"), "CustomerID", "InvoiceNo", "ProductID", "Quantity")
    return ranked.limit(n) if n is not None else ranked


def sensitivity_summary(lines: DataFrame, predicate: Column, focus: Column, names: tuple[str, str] = ("With", "Without")) -> DataFrame:
    """Customer value figures with and without the rows of an exclusion, side by side, from one grouping of the lines."""
    spend, zero = F.col("TotalSpend"), F.lit(0).cast("decimal(18,2)")

    def version(name: str, rows: Column) -> Column:
        return F.struct(
            F.lit(name).alias("Version"), F.count_if(rows).alias("__lines"), F.sum(F.when(rows, spend)).alias("Monetary"),
            F.coalesce(F.sum(F.when(rows & focus, spend)), zero).alias("FocusSpend"))

    each = lines.groupBy("CustomerID").agg(
        version(names[0], F.lit(True)).alias("a"), version(names[1], F.coalesce(~predicate, F.lit(False))).alias("b"))
    both = written(each.select("CustomerID", F.inline(F.array("a", "b"))).where("__lines > 0"))
    both = both.withColumn("__buyer_spend", F.when(F.col("FocusSpend") > 0, F.col("FocusSpend")))
    return summarise(
        both,
        [
            F.count(F.lit(1)).alias("Customers"),
            F.sum("Monetary").alias("Total_Sales"),
            mean_of(F.col("Monetary")).alias("Mean_Monetary"),
            F.max("Monetary").alias("Max_Monetary"),
            F.sum("FocusSpend").alias("Total_Focus_Spend"),
            mean_of(F.col("FocusSpend")).alias("Mean_Focus_Spend"),
            F.max("FocusSpend").alias("Max_Focus_Spend"),
        ],
        {"Median_Monetary": "Monetary", "Median_Focus_Spend_Buyers": "__buyer_spend"},
        by=["Version"],
    )
