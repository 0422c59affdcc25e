"""Data-quality profiles and cleaning of transaction lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, mean_of
from .rank import running, summarise


def _blank_aware(name: str, dtype: str, blank_is_missing: bool) -> Column:
    missing = is_missing(name, dtype)
    if blank_is_missing and dtype == "string":
        return missing | (F.trim(F.col(f"`{name}`")) == "")
    return missing


def missing_profile(df: DataFrame, blank_is_missing: bool = False) -> DataFrame:
    """Missing values per column, most first: one scan, then a reshape of one row."""
    counts = df.agg(*[F.count_if(_blank_aware(c, t, blank_is_missing)).alias(c) for c, t in df.dtypes])
    return counts.unpivot([], df.columns, "Variable", "Missing_Count").orderBy(
        F.desc("Missing_Count"), "Variable"
    )


# Types whose equal values have equal hashes.
_FLAT = ("string", "boolean", "date", "timestamp", "timestamp_ntz", "binary", "tinyint", "smallint", "int", "bigint", "decimal")


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit numbers per row; equal rows have equal ones. Nulls count by their place; columns whose equal values may differ in
    their bytes are left out."""
    cells = []
    for name, kind in df.dtypes:
        if kind.split("(")[0] in _FLAT:
            cells += [F.col(f"`{name}`"), F.col(f"`{name}`").isNull()]
    return [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column.

    What is shuffled for every row is its fingerprint; rows are compared in full only where fingerprints repeat, so that the
    count is exact whatever the fingerprints do.
    """
    names = ["__f1", "__f2"]
    marked = df.select("*", *[c.alias(n) for c, n in zip(row_fingerprint(df), names)])
    repeated = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return (
        marked.join(repeated, names, "left_semi")
        .groupBy(*[f"`{c}`" for c in df.columns])
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_duplicates"))
    )


def distinct_counts(df: DataFrame, columns: dict[str, str], nulls: bool = False) -> DataFrame:
    """One row: the distinct values of each ``output name -> column``, a null counting as one more if ``nulls``.

    One scan groups by every column on its own: what is shuffled is each task's distinct values of each column, and a value
    that many rows share counts once a task.
    """
    used = list(dict.fromkeys(columns.values()))
    keys = [F.col(f"`{c}`") for c in used]
    values = df.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("__set"))
    every = (1 << len(used)) - 1  # grouping_id has a bit for each column that a row is not grouped by, the last column lowest

    def counted(c: str) -> Column:
        own = F.col("__set") == every ^ (1 << (len(used) - 1 - used.index(c)))
        return F.count_if(own if nulls else own & F.col(f"`{c}`").isNotNull())

    return values.agg(*[counted(c).alias(name) for name, c in columns.items()])


def cardinality_profile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Row count and distinct counts; ``columns`` maps output name to column."""
    return df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(distinct_counts(df, columns, nulls=True)))


def range_profile(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """min_x / max_x for each ``suffix -> column``."""
    return df.agg(*[
        f(c).alias(f"{label}_{suffix}")
        for suffix, c in columns.items() for label, f in (("min", F.min), ("max", F.max))
    ])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value combination, nulls as a group, most frequent first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def nonpositive_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("UnitPrice") <= 0).alias("zero_or_negative_price"),
        F.count_if(F.col("Quantity") <= 0).alias("zero_or_negative_quantity"),
        F.count_if(F.col("TotalSpend") <= 0).alias("zero_or_negative_spend"),
    )


def clean_transactions(raw: DataFrame, blank_is_missing: bool = False, lookups: Sequence[DataFrame] = (),
                       join: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Distinct rows with a category; dates typed; line spend added.

    The filter runs before the distinct, so dropped rows are never shuffled. Repeated rows
    combine map-side, so a row copied many times costs its partitions one entry each.

    Where the rows are those of ``join(raw, *lookups)``, inner joins on equal columns that give every column of the tables,
    each table is filtered and made distinct on its own: a row then tells the row of every table that it was made from, so
    joined rows repeat only where a table's rows do, and wide rows are never grouped.
    """
    def kept(df: DataFrame) -> DataFrame:
        if "ProductCategory" not in df.columns:
            return df
        keep = F.col("ProductCategory").isNotNull()
        if blank_is_missing:
            keep = keep & (F.trim("ProductCategory") != "")
        return df.where(keep)

    tables = [kept(t).distinct() for t in (raw, *lookups)]
    rows = join(*tables) if join else tables[0]
    return rows.withColumns({
        "InvoiceDate": F.col("InvoiceDate").cast("date"),
        "TotalSpend": (F.col("UnitPrice") * F.col("Quantity")).cast("decimal(18,2)"),
    })


def exclude_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows for which the documented predicate holds.

    Three-valued like the reference's filter: rows for which it is unknown are dropped too.
    """
    return df.where(~predicate)


def cleaning_summary(before: DataFrame, predicate: Column, focus: Column) -> DataFrame:
    """Rows, customers, sales and focus spend before and after an exclusion, in one scan."""
    spend = F.col("TotalSpend")
    kept = ~predicate
    sums = {
        "Sales": (F.sum(spend), F.sum(F.when(kept, spend))),
        "Focus_Spend": (F.sum(F.when(focus, spend)), F.sum(F.when(kept & focus, spend))),
    }
    # sums per customer first, so that the customers are counted without a distinct
    each = before.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(kept).alias("__kept"),
        *[c.alias(f"{k}_{side}") for k, both in sums.items() for c, side in zip(both, ("Before", "After"))],
    )
    known = F.col("CustomerID").isNotNull()
    counts = each.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("Rows_Before"),
        F.coalesce(F.sum("__kept"), F.lit(0)).alias("Rows_After"),
        F.count_if(known).alias("Customers_Before"),
        F.count_if(known & (F.col("__kept") > 0)).alias("Customers_After"),
        *[F.sum(f"{k}_{side}").alias(f"{k}_{side}") for k in sums for side in ("Before", "After")],
    )
    return counts.select(
        "Rows_Before", "Rows_After", (F.col("Rows_Before") - F.col("Rows_After")).alias("Rows_Removed"),
        "Customers_Before", "Customers_After",
        *[c for k in sums for c in (
            f"{k}_Before", f"{k}_After", (F.col(f"{k}_Before") - F.col(f"{k}_After")).alias(f"{k}_Removed"))],
    )


def transaction_summary(df: DataFrame) -> DataFrame:
    totals = summarise(
        df,
        [
            F.count(F.lit(1)).alias("rows"),
            F.sum("TotalSpend").alias("total_sales"),
            mean_of(F.col("TotalSpend")).alias("average_line_spend"),
            F.max("Quantity").alias("max_quantity"),
            F.max("TotalSpend").alias("max_line_spend"),
        ],
        {"median_line_spend": "TotalSpend"},
    )
    unique = distinct_counts(df, {
        "unique_customers": "CustomerID", "unique_invoices": "InvoiceNo", "unique_products": "ProductID",
        "unique_categories": "ProductCategory"})
    return totals.crossJoin(F.broadcast(unique))


# The columns of a reported line, in order.
LINE_COLUMNS = [
    "InvoiceNo", "InvoiceDate", "CustomerID", "ProductID", "ProductCategory", "UnitPrice", "Quantity", "TotalSpend",
]


def top_lines(df: DataFrame, n: int = 20, columns: Sequence[str] = tuple(LINE_COLUMNS)) -> DataFrame:
    """Highest-spend lines; ties in key order. Plans as a per-partition top-n."""
    ties = ["CustomerID", "InvoiceNo", "ProductID", "Quantity"]
    return df.select(*columns).orderBy(F.desc("TotalSpend"), *ties).limit(n)


def category_sales(df: DataFrame) -> DataFrame:
    """Sales per category with rank, by slices of the order whatever the number of categories."""
    sales = df.groupBy("ProductCategory").agg(F.sum("TotalSpend").alias("TotalSales"))
    ranked = running(sales.withColumn("__down", -F.col("TotalSales")), [], ["__down", "ProductCategory"], F.lit(1))
    return ranked.withColumn("CategoryRank", F.col("cum").cast("int")).drop("__down", "cum", "n")


def category_position(df: DataFrame, category: str) -> DataFrame:
    """Sales and rank of one category, without ranking the rest: count who sells more."""
    sales = df.groupBy("ProductCategory").agg(F.sum("TotalSpend").alias("TotalSales"))
    own = sales.where(F.col("ProductCategory") == category).select(
        F.col("ProductCategory").alias("Category"), F.col("TotalSales").alias("CategorySales"))
    ahead = (F.col("TotalSales") > F.col("CategorySales")) | (
        (F.col("TotalSales") == F.col("CategorySales")) & (F.col("ProductCategory") < F.col("Category")))
    return sales.crossJoin(F.broadcast(own)).groupBy("Category", "CategorySales").agg(
        (F.count_if(ahead) + 1).alias("CategoryRank"))
