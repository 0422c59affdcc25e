"""Recency / frequency / monetary scoring and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import currency_label, mean_of, percent_label, ratio, total_of
from .features import group_shares
from .rank import NTile, add_ntiles, summarise

# The columns of the scoring base, in order.
BASE_COLUMNS = [
    "CustomerID", "Recency", "Frequency", "Monetary", "FocusSpend", "FocusBuyer", "FocusShare",
    "Income", "Age", "HouseholdSize", "Married", "Work", "Education",
]

# Segment names in report order.
SEGMENTS = [
    "Champions", "Loyal high-value", "Recent low-frequency", "At-risk high-value", "Low-value inactive",
    "Promising", "Moderate", "Needs attention", "Low priority",
]

INDEPENDENT, SEQUENTIAL = "ind", "seq"


def rfm_base(customers: DataFrame) -> DataFrame:
    return customers.select(*BASE_COLUMNS)


def rfm_distribution(base: DataFrame) -> DataFrame:
    """Customer count and min / median / mean / max of the three measures."""
    measures = ["Recency", "Frequency", "Monetary"]
    plain = [F.count(F.lit(1)).alias("Customers")]
    for m in measures:
        plain += [F.min(m).alias(f"Min_{m}"), mean_of(F.col(m)).alias(f"Mean_{m}"), F.max(m).alias(f"Max_{m}")]
    return summarise(base, plain, {f"Median_{m}": m for m in measures})


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """First matching rule; specific behaviour before total score."""
    # The thresholds, names and order of the segments.
    total = r + f + m
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 4) & (f >= 3) & (m >= 3), "Loyal high-value")
        .when((r >= 4) & (f <= 2), "Recent low-frequency")
        .when((r <= 2) & (f >= 4) & (m >= 4), "At-risk high-value")
        .when((r <= 2) & (f <= 2) & (m <= 2), "Low-value inactive")
        .when(total >= 11, "Promising")
        .when(total >= 8, "Moderate")
        .when(total >= 5, "Needs attention")
        .otherwise("Low priority")
    )


def _with_totals(scored: DataFrame, method: str) -> DataFrame:
    r, f, m = (F.col(f"{x}_score_{method}") for x in "RFM")
    return scored.withColumns({
        f"RFM_score_{method}": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
        f"RFM_total_{method}": r + f + m,
        f"RFM_segment_{method}": segment_of(r, f, m),
    })


def score_independent(customers: DataFrame, buckets: int = 5, slices: int | None = None) -> DataFrame:
    """Each measure scored over the whole base; the most recent customers score highest."""
    specs = [
        NTile("R_score_ind", "Recency", descending=True, buckets=buckets),
        NTile("F_score_ind", "Frequency", buckets=buckets),
        NTile("M_score_ind", "Monetary", buckets=buckets),
    ]
    return _with_totals(add_ntiles(customers, specs, "CustomerID", slices), INDEPENDENT)


def score_sequential(customers: DataFrame, buckets: int = 5) -> DataFrame:
    """Recency over the base, frequency within recency, monetary within both."""
    recency = [] if "R_score_seq" in customers.columns else [
        NTile("R_score_seq", "Recency", descending=True, buckets=buckets)]
    specs = recency + [
        NTile("F_score_seq", "Frequency", by=("R_score_seq",), buckets=buckets),
        NTile("M_score_seq", "Monetary", by=("R_score_seq", "F_score_seq"), buckets=buckets),
    ]
    return _with_totals(add_ntiles(customers, specs, "CustomerID"), SEQUENTIAL)


def score_both(customers: DataFrame) -> DataFrame:
    """Both scorings on one frame: no join of the customer table to itself, recency scored once."""
    independent = score_independent(customers)
    return score_sequential(independent.withColumn("R_score_seq", F.col("R_score_ind")))


def score_ranges(scored: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    names = {"R": f"R_score_{method}", "F": f"F_score_{method}", "M": f"M_score_{method}", "Total": f"RFM_total_{method}"}
    return scored.agg(*[g(c).alias(f"{k}_{s}") for k, c in names.items() for g, s in ((F.min, "min"), (F.max, "max"))])


def score_cells(scored: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    """Customers and averages per exact score, most common first."""
    key = f"RFM_score_{method}"
    return (
        scored.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("Customers"),
            mean_of(F.col("Recency")).alias("Avg_Recency"),
            mean_of(F.col("Frequency")).alias("Avg_Frequency"),
            mean_of(F.col("Monetary")).alias("Avg_Monetary"),
            mean_of(F.col("FocusBuyer")).alias("Focus_Buyer_Rate"),
            mean_of(F.col("FocusSpend")).alias("Avg_Focus_Spend"),
        )
        .orderBy(F.desc("Customers"), key)
    )


def segment_counts(scored: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    key = f"RFM_segment_{method}"
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def segment_summary(scored: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    """Twelve measures per segment, highest average value first."""
    key = f"RFM_segment_{method}"
    groups = summarise(
        scored,
        [
            F.count(F.lit(1)).alias("Customers"),
            mean_of(F.col("Recency")).alias("Avg_Recency"),
            mean_of(F.col("Frequency")).alias("Avg_Frequency"),
            mean_of(F.col("Monetary")).alias("Avg_Monetary"),
            F.sum("Monetary").alias("Total_Monetary"),
            F.sum("FocusBuyer").alias("Focus_Buyers"),
            mean_of(F.col("FocusBuyer")).alias("Focus_Buyer_Rate"),
            mean_of(F.col("FocusSpend")).alias("Avg_Focus_Spend"),
        ],
        {"Median_Monetary": "Monetary", "Median_Age": "Age", "Median_Income": "Income"},
        by=[key],
    )
    return (
        groups.select(
            key, "Customers", ratio(F.col("Customers"), total_of("Customers")).alias("Customer_Share"),
            "Avg_Recency", "Avg_Frequency", "Avg_Monetary", "Median_Monetary", "Total_Monetary",
            "Focus_Buyers", "Focus_Buyer_Rate", "Avg_Focus_Spend", "Median_Age", "Median_Income",
        )
        .orderBy(F.desc("Avg_Monetary"), key)
    )


def compare_methods(scored: DataFrame) -> DataFrame:
    """Both scores per customer and whether the segments agree."""
    return scored.select(
        "CustomerID", "RFM_score_ind", "RFM_total_ind", "RFM_segment_ind",
        "RFM_score_seq", "RFM_total_seq", "RFM_segment_seq",
        (F.col("RFM_segment_ind") == F.col("RFM_segment_seq")).alias("Same_Segment"),
    )


def join_scores(customers: DataFrame, independent: DataFrame, sequential: DataFrame) -> DataFrame:
    """Attach separately stored scorings to the customer table by key (left joins)."""
    columns = lambda m: ["CustomerID"] + [f"{x}_score_{m}" for x in "RFM"] + [
        f"RFM_score_{m}", f"RFM_total_{m}", f"RFM_segment_{m}"]
    return customers.join(independent.select(*columns(INDEPENDENT)), "CustomerID", "left").join(
        sequential.select(*columns(SEQUENTIAL)), "CustomerID", "left")


def crosstab(df: DataFrame, rows: str, columns: str, levels: list[str], row_levels: list[str] | None = None) -> DataFrame:
    """Counts with every cell present, one column per level; rows of unseen levels are kept as zeros."""
    cells = df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(str(v)) for v in levels])
    if row_levels is None:
        return cells
    grid = df.sparkSession.createDataFrame([(v,) for v in row_levels], [rows])
    return grid.join(cells, rows, "left").fillna(0, [str(v) for v in levels])


def segment_crosstab(comparison: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Independent segment by sequential segment."""
    return crosstab(comparison, "RFM_segment_ind", "RFM_segment_seq", levels or SEGMENTS)


def method_agreement(comparison: DataFrame) -> DataFrame:
    same = F.col("Same_Segment").cast("int")
    return comparison.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.sum(same).alias("Same_Segment_Count"),
        mean_of(same).alias("Same_Segment_Rate"),
    )


def agreement_split(comparison: DataFrame) -> DataFrame:
    status = F.when(F.col("Same_Segment"), "Same segment").otherwise("Different segment")
    return group_shares(comparison.withColumn("Agreement_Status", status), "Agreement_Status")


def profile_long(summary: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    """Average recency, frequency and monetary per segment in long form."""
    key = f"RFM_segment_{method}"
    return summary.select(
        key,
        F.col("Avg_Recency").alias("Average recency"),
        F.col("Avg_Frequency").alias("Average frequency"),
        F.col("Avg_Monetary").alias("Average monetary"),
    ).unpivot([key], ["Average recency", "Average frequency", "Average monetary"], "Metric", "Value")


def segment_report(summary: DataFrame, method: str = INDEPENDENT) -> DataFrame:
    """Formatted segment table."""
    return summary.select(
        F.col(f"RFM_segment_{method}").alias("Segment"),
        "Customers",
        percent_label(F.col("Customer_Share")).alias("Share"),
        F.round("Avg_Recency", 1).alias("Avg recency (days)"),
        F.round("Avg_Frequency", 2).alias("Avg frequency"),
        currency_label(F.col("Avg_Monetary")).alias("Avg monetary (£)"),
        percent_label(F.col("Focus_Buyer_Rate")).alias("Focus buyer rate"),
    ).orderBy(F.desc("Customers"), "Segment")


def method_comparison(comparison: DataFrame) -> DataFrame:
    """Per method: champions, largest segment with size and share, and the agreement figures."""
    long = comparison.select(
        "Same_Segment",
        F.explode(F.create_map(
            F.lit("Independent"), F.col("RFM_segment_ind"), F.lit("Sequential"), F.col("RFM_segment_seq"),
        )).alias("Method", "Segment"),
    )
    per_segment = long.groupBy("Method", "Segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("Same_Segment").cast("int")).alias("same"))
    # most customers first, then segment name
    largest = F.min_by(F.struct("Segment", "n"), F.struct((-F.col("n")).alias("k"), "Segment"))
    return per_segment.groupBy("Method").agg(
        F.sum(F.when(F.col("Segment") == "Champions", F.col("n")).otherwise(0)).alias("Champions"),
        largest.alias("top"),
        F.sum("n").alias("Customers"),
        F.sum("same").alias("Same_Segment_Count"),
    ).select(
        "Method", "Champions",
        F.col("top.Segment").alias("Largest_Segment"),
        F.col("top.n").alias("Largest_Customers"),
        ratio(F.col("top.n"), F.col("Customers")).alias("Largest_Share"),
        "Same_Segment_Count",
        ratio(F.col("Same_Segment_Count"), F.col("Customers")).alias("Same_Segment_Rate"),
    )
