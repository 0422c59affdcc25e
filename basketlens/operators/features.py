"""Customer features from transaction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_label, mean_of, ratio, safe_log, total_of
from ..session import written
from .common import join_on_keys
from .rank import summarise

# The demographic columns and the order that tells which line is first.
DEMOGRAPHIC_COLUMNS = ["Married", "HouseholdSize", "Income", "Age", "ZipCode", "Work", "Education"]
FIRST_ROW_ORDER = ["InvoiceDate", "InvoiceNo", "ProductID", "Quantity"]


def focus_category(category: str, column: str = "ProductCategory") -> Column:
    """The category predicate that every focus measure is built on."""
    return F.col(column) == category


def _measures(focus: Column) -> dict[str, Column]:
    spend = F.col("TotalSpend")
    zero = F.lit(0)
    return {
        "Frequency": F.count_distinct("InvoiceNo"),
        "Monetary": F.sum(spend),
        "FocusSpend": F.coalesce(F.sum(F.when(focus, spend)), zero.cast("decimal(18,2)")),
        "FocusQuantity": F.coalesce(F.sum(F.when(focus, F.col("Quantity"))), zero),
    }


def _recency() -> Column:
    return F.datediff("__analysis_date", "last_purchase_date")


def _buyer() -> Column:
    return F.when(F.col("FocusSpend") > 0, 1).otherwise(0)


def customer_summary_min(lines: DataFrame, focus: Column) -> DataFrame:
    """Recency, frequency, spend and focus measures per customer."""
    per_customer = lines.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("last_purchase_date"), *[c.alias(k) for k, c in _measures(focus).items()])
    last = per_customer.agg(F.date_add(F.max("last_purchase_date"), 1).alias("__analysis_date"))
    return per_customer.crossJoin(F.broadcast(last)).select(
        "CustomerID", _recency().alias("Recency"), "Frequency", "Monetary", "FocusSpend", "FocusQuantity",
        _buyer().alias("FocusBuyer"),
    )


def first_row_values(lines: DataFrame, columns: Sequence[str], order: Sequence[str] = tuple(FIRST_ROW_ORDER)) -> DataFrame:
    """Each customer's values on the earliest line, nulls included."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return lines.groupBy("CustomerID").agg(first.alias("__first")).select("CustomerID", "__first.*")


def customer_features(
    lines: DataFrame, focus: Column, demographics: Sequence[str] = tuple(DEMOGRAPHIC_COLUMNS)
) -> DataFrame:
    """One row per customer: purchase dates, RFM measures, diversity, focus measures, demographics.

    The columns that count are written once, and each measure reads its own from there: lines are formed a single time. Sums
    combine by (customer, invoice), different products and categories by (customer, value), map-side and then over the
    cluster, so the counts need no distinct and a customer with a third of all lines is spread over many tasks. The structs
    that tell a first line are aggregated on their own: beside them every other aggregate would have to sort its rows.
    """
    used = dict.fromkeys(["CustomerID", *FIRST_ROW_ORDER, "ProductCategory", "TotalSpend", *demographics])
    kept = written(lines.select(*used, focus.alias("__focus")))
    spend, quantity, wanted = F.col("TotalSpend"), F.col("Quantity"), F.col("__focus")
    invoices = kept.groupBy("CustomerID", "InvoiceNo").agg(
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
        F.sum(spend).alias("spend"),
        F.sum(quantity).alias("quantity"),
        F.sum(F.when(wanted, spend)).alias("focus_spend"),
        F.sum(F.when(wanted, quantity)).alias("focus_quantity"),
        F.max(wanted).alias("has_focus"),
    )
    per_customer = invoices.groupBy("CustomerID").agg(
        F.min("first").alias("first_purchase_date"),
        F.max("last").alias("last_purchase_date"),
        F.count("InvoiceNo").alias("Frequency"),
        F.sum("spend").alias("Monetary"),
        F.sum("quantity").alias("TotalQuantity"),
        F.coalesce(F.sum("focus_spend"), F.lit(0).cast("decimal(18,2)")).alias("FocusSpend"),
        F.coalesce(F.sum("focus_quantity"), F.lit(0)).alias("FocusQuantity"),
        F.count(F.when(F.col("has_focus"), F.col("InvoiceNo"))).alias("FocusInvoices"),
    )
    variety = [
        kept.select("CustomerID", c).distinct().groupBy("CustomerID").agg(F.count(c).alias(name))
        for c, name in (("ProductCategory", "CategoryDiversity"), ("ProductID", "ProductDiversity"))
    ]
    dated = per_customer.join(variety[0], "CustomerID", "left").join(variety[1], "CustomerID", "left").crossJoin(
        F.broadcast(kept.agg(F.date_add(F.max("InvoiceDate"), 1).alias("__analysis_date"))))
    if demographics:
        dated = join_on_keys(dated, first_row_values(kept, demographics), ["CustomerID"])
    return dated.select(
        "CustomerID",
        "first_purchase_date",
        "last_purchase_date",
        _recency().alias("Recency"),
        "Frequency",
        "Monetary",
        ratio(F.col("Monetary"), F.col("Frequency")).alias("AvgBasketValue"),
        "TotalQuantity",
        "CategoryDiversity",
        "ProductDiversity",
        "FocusSpend",
        "FocusQuantity",
        "FocusInvoices",
        *demographics,
        _buyer().alias("FocusBuyer"),
        F.coalesce(ratio(F.col("FocusSpend"), F.col("Monetary")), F.lit(0.0)).alias("FocusShare"),
    )


def customer_features_initial(lines: DataFrame, focus: Column,
                              demographics: Sequence[str] = tuple(DEMOGRAPHIC_COLUMNS)) -> DataFrame:
    """Features before any exclusion, for the influence check: share 0 without spend, log spend added."""
    base = customer_features(lines, focus, demographics)
    share = F.when(F.col("Monetary") > 0, F.col("FocusShare")).otherwise(F.lit(0.0))
    return base.withColumns({"FocusShare": share, "LogMonetary": safe_log(F.col("Monetary"))})


def varying_demographics(lines: DataFrame, columns: Sequence[str] = tuple(DEMOGRAPHIC_COLUMNS)) -> DataFrame:
    """Customers whose lines disagree on a demographic, per column (the first line wins)."""
    per_customer = lines.groupBy("CustomerID").agg(*[
        (F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))).alias(c)
        for c in columns
    ])
    counts = per_customer.agg(*[F.count_if(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "Variable", "Customers")


def customer_base_summary(customers: DataFrame) -> DataFrame:
    """Size, value, frequency, recency and focus figures of the customer base."""
    buyer_spend = F.when(F.col("FocusBuyer") == 1, F.col("FocusSpend"))
    return summarise(
        customers.withColumn("__buyer_spend", buyer_spend),
        [
            F.count(F.lit(1)).alias("Customers"),
            F.sum("Monetary").alias("Total_Sales"),
            mean_of(F.col("Monetary")).alias("Average_Monetary"),
            mean_of(F.col("Frequency")).alias("Average_Frequency"),
            mean_of(F.col("Recency")).alias("Average_Recency"),
            F.sum("FocusBuyer").alias("Focus_Buyers"),
            mean_of(F.col("FocusBuyer")).alias("Focus_Buyer_Rate"),
            F.max("__buyer_spend").alias("Max_Focus_Spend"),
        ],
        {
            "Median_Monetary": "Monetary", "Median_Frequency": "Frequency", "Median_Recency": "Recency",
            "Median_Focus_Spend_Buyers": "__buyer_spend",
        },
    )


def log_features(customers: DataFrame) -> DataFrame:
    """Log of the skewed measures; null where a log does not exist."""
    return customers.withColumns({
        "LogMonetary": safe_log(F.col("Monetary")),
        "LogAvgBasketValue": safe_log(F.col("AvgBasketValue")),
        "LogTotalQuantity": safe_log(F.col("TotalQuantity")),
        "LogFocusSpend": F.log1p(F.col("FocusSpend").cast("double")),
        "LogFocusQuantity": F.log1p(F.col("FocusQuantity").cast("double")),
    })


def buyer_group(focus_name: str = "Focus") -> Column:
    name = F.when(F.col("FocusBuyer") == 1, F.lit(f"{focus_name} buyer"))
    return name.otherwise(F.lit(f"Non-{focus_name.lower()} buyer"))


def group_shares(df: DataFrame, *keys: str, share: str = "Share", label: str | None = "Label") -> DataFrame:
    """Rows per group, share of all rows and a bar label. The total is the sum of the result rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn(share, ratio(F.col("n"), total_of("n")))
    return out.withColumn(label, count_label(F.col("n"), F.col(share))) if label else out


def buyer_split(customers: DataFrame, focus_name: str = "Focus") -> DataFrame:
    """Buyers of the focus category against the rest: count, share, label."""
    return group_shares(customers.withColumn("BuyerGroup", buyer_group(focus_name)), "BuyerGroup", share="Pct")
