"""Queries on customers: features, base figures, RFM, chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as V
from ..operators import features as C
from ..operators import outliers as U
from ..operators import rfm as R
from ..operators.rank import NTile, add_ntiles
from . import base as B
from .shape import Book

book = Book()
add = book.add
avg = B.avg_sql

FEATURES = (
    "CustomerID:i; first_purchase_date:d; last_purchase_date:d; Recency:i; Frequency:i; Monetary:f; AvgBasketValue:f; "
    "TotalQuantity:i; CategoryDiversity:i; ProductDiversity:i; FocusSpend:f; FocusQuantity:i; FocusInvoices:i; Married:i; "
    "HouseholdSize:i; Income:f; Age:i; ZipCode:s; Work:s; Education:i; FocusBuyer:i; FocusShare:f")


def money_label_sql(column: str, digits: int = 0) -> str:
    return f"concat('£', format('{{:,.{digits}f}}', CAST({column} AS DOUBLE)))"


def percent_label_sql(column: str) -> str:
    return f"concat(format('{{:.1f}}', 100 * CAST({column} AS DOUBLE)), '%')"


# ------------------------------------------------------------------ features

add("customer_summary_min",
    "CustomerID:i; Recency:i; Frequency:i; Monetary:f; FocusSpend:f; FocusQuantity:i; FocusBuyer:i",
    lambda s, d: C.customer_summary_min(B.lines(s, d), B.focus()), "SELECT * FROM people", B.PEOPLE)
add("customer_features", FEATURES, lambda s, d: C.customer_features(B.lines(s, d), B.focus()),
    "SELECT * FROM people", B.PEOPLE)
add("customer_features_initial", FEATURES + "; LogMonetary:f",
    lambda s, d: C.customer_features_initial(B.lines(s, d), B.focus()),
    "SELECT *, ln(CAST(Monetary AS DOUBLE)) AS LogMonetary FROM people", B.PEOPLE)
add("customer_features_after_exclusion", FEATURES,
    lambda s, d: C.customer_features(B.lines(s, d).where(~B.exclusion()), B.focus()),
    "SELECT * FROM people_without", B.LINES + ",\n" + B.features_cte("people_without", "lines", f"NOT {B.EXCLUDE_SQL}"))
# demographics that differ from line to line, some of them missing
_varying = ("CASE WHEN InvoiceNo % 5 = 0 THEN NULL ELSE Income + InvoiceNo % 3 END AS Income",
            "CASE WHEN ProductID % 4 = 0 THEN NULL ELSE Age + Quantity % 2 END AS Age")
_first = "(first(struct_pack(i := Income, a := Age) ORDER BY InvoiceDate, InvoiceNo, ProductID, Quantity))"
add("first_row_demographics", "CustomerID:i; Income:f; Age:i",
    lambda s, d: C.first_row_values(
        B.lines(s, d).selectExpr("CustomerID", "InvoiceDate", "InvoiceNo", "ProductID", "Quantity", *_varying),
        ["Income", "Age"]),
    f"SELECT CustomerID, {_first}.i AS Income, {_first}.a AS Age FROM varying GROUP BY CustomerID",
    B.LINES + f", varying AS (SELECT CustomerID, InvoiceDate, InvoiceNo, ProductID, Quantity, {', '.join(_varying)} FROM lines)")
add("varying_demographics", "Variable:s; Customers:i",
    lambda s, d: C.varying_demographics(
        B.lines(s, d).selectExpr("CustomerID", *_varying, "HouseholdSize"), ["Income", "Age", "HouseholdSize"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS Variable, count(*) FILTER (WHERE k > 1) AS Customers FROM
        (SELECT count(DISTINCT coalesce(CAST({c} AS VARCHAR), '?')) AS k FROM varying GROUP BY CustomerID)"""
        for c in ("Income", "Age", "HouseholdSize")),
    B.LINES + f", varying AS (SELECT CustomerID, {', '.join(_varying)}, HouseholdSize FROM lines)")

_base_sql = f"""SELECT count(*) AS Customers, sum(Monetary) AS Total_Sales, {avg('Monetary')} AS Average_Monetary,
  {avg('Frequency')} AS Average_Frequency, {avg('Recency')} AS Average_Recency, sum(FocusBuyer) AS Focus_Buyers,
  {avg('FocusBuyer')} AS Focus_Buyer_Rate, max(FocusSpend) FILTER (WHERE FocusBuyer = 1) AS Max_Focus_Spend,
  median(CAST(Monetary AS DOUBLE)) AS Median_Monetary, median(Frequency) AS Median_Frequency, median(Recency) AS Median_Recency,
  median(CAST(FocusSpend AS DOUBLE)) FILTER (WHERE FocusBuyer = 1) AS Median_Focus_Spend_Buyers FROM people"""
add("customer_base_summary",
    "Customers:i; Total_Sales:f; Average_Monetary:f; Median_Monetary:f; Average_Frequency:f; Median_Frequency:f; "
    "Average_Recency:f; Median_Recency:f; Focus_Buyers:i; Focus_Buyer_Rate:f; Max_Focus_Spend:f; Median_Focus_Spend_Buyers:f",
    lambda s, d: C.customer_base_summary(B.people(s, d)), _base_sql, B.PEOPLE)
add("log_features",
    "CustomerID:i; LogMonetary:f; LogAvgBasketValue:f; LogTotalQuantity:f; LogFocusSpend:f; LogFocusQuantity:f",
    lambda s, d: C.log_features(B.people(s, d)),
    """SELECT CustomerID, ln(CAST(Monetary AS DOUBLE)) AS LogMonetary, ln(AvgBasketValue) AS LogAvgBasketValue,
       ln(TotalQuantity) AS LogTotalQuantity, ln(1 + CAST(FocusSpend AS DOUBLE)) AS LogFocusSpend,
       ln(1 + FocusQuantity) AS LogFocusQuantity FROM people""", B.PEOPLE)
_split = """SELECT *, concat(n, chr(10), '(', {pct}, ')') AS Label FROM
  (SELECT {key}, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM {src}) AS {share} FROM {src} GROUP BY 1)"""
add("buyer_split", "BuyerGroup:s; n:i; Pct:f; Label:s", lambda s, d: C.buyer_split(B.people(s, d)),
    _split.format(key="CASE WHEN FocusBuyer = 1 THEN 'Focus buyer' ELSE 'Non-focus buyer' END AS BuyerGroup",
                  src="people", share="Pct", pct=percent_label_sql("Pct")), B.PEOPLE)
add("cap_at_percentile", "CustomerID:i; FocusSpend:f",
    lambda s, d: U.cap_at_percentile(B.people(s, d).where("FocusBuyer = 1"), "FocusSpend", 0.95),
    """SELECT CustomerID, FocusSpend FROM people WHERE FocusBuyer = 1 AND CAST(FocusSpend AS DOUBLE) <=
       (SELECT quantile_cont(CAST(FocusSpend AS DOUBLE), 0.95) FROM people WHERE FocusBuyer = 1)""", B.PEOPLE)

# ------------------------------------------------------------------ RFM

add("rfm_base", "CustomerID:i; Recency:i; Frequency:i; Monetary:f; FocusSpend:f; FocusBuyer:i; FocusShare:f; Income:f; "
    "Age:i; HouseholdSize:i; Married:i; Work:s; Education:i", lambda s, d: R.rfm_base(B.people(s, d)),
    "SELECT * FROM people", B.PEOPLE)
add("rfm_distribution",
    "Customers:i; " + "; ".join(f"{k}_{m}:f" for m in ("Recency", "Frequency", "Monetary")
                                for k in ("Min", "Median", "Mean", "Max")),
    lambda s, d: R.rfm_distribution(R.rfm_base(B.people(s, d))),
    "SELECT count(*) AS Customers, " + ", ".join(
        f"min({m}) AS Min_{m}, median(CAST({m} AS DOUBLE)) AS Median_{m}, {avg(m)} AS Mean_{m}, max({m}) AS Max_{m}"
        for m in ("Recency", "Frequency", "Monetary")) + " FROM people", B.PEOPLE)

_scores = lambda m: f"R_score_{m}:i; F_score_{m}:i; M_score_{m}:i; RFM_score_{m}:s; RFM_total_{m}:i; RFM_segment_{m}:s"
add("rfm_independent", "CustomerID:i; " + _scores("ind"), lambda s, d: R.score_independent(B.people(s, d)),
    "SELECT * FROM scored", B.SCORED)
add("rfm_sequential", "CustomerID:i; " + _scores("seq"), lambda s, d: R.score_sequential(B.people(s, d)),
    "SELECT * FROM scored", B.SCORED)
add("rfm_scores_by_cut_points", "CustomerID:i; " + _scores("ind"),
    lambda s, d: R.score_independent(B.people(s, d), slices=7), "SELECT * FROM scored", B.SCORED)
add("ntile_heavy_ties", "CustomerID:i; tile:i; inner_tile:i",
    lambda s, d: add_ntiles(B.people(s, d).withColumn("few", F.col("CustomerID") % 3), [
        NTile("tile", "few", buckets=7), NTile("inner_tile", "few", descending=True, by=("tile",), buckets=4)], "CustomerID", slices=6),
    """SELECT CustomerID, tile, ntile(4) OVER (PARTITION BY tile ORDER BY CustomerID % 3 DESC, CustomerID) AS inner_tile
    FROM (SELECT CustomerID, ntile(7) OVER (ORDER BY CustomerID % 3, CustomerID) AS tile FROM people)""", B.PEOPLE)
for _m in ("ind", "seq"):
    _name = {"ind": "independent", "seq": "sequential"}[_m]
    _key = f"RFM_segment_{_m}"
    add(f"rfm_{_name}_score_ranges",
        "; ".join(f"{k}_{x}:i" for k in ("R", "F", "M", "Total") for x in ("min", "max")),
        lambda s, d, m=_m: R.score_ranges(B.scored(s, d), m),
        "SELECT " + ", ".join(
            f"{x}({c}) AS {k}_{x}" for k, c in (
                ("R", f"R_score_{_m}"), ("F", f"F_score_{_m}"), ("M", f"M_score_{_m}"), ("Total", f"RFM_total_{_m}"))
            for x in ("min", "max")) + " FROM scored", B.SCORED)
    add(f"rfm_{_name}_table",
        f"RFM_score_{_m}:s; Customers:i; Avg_Recency:f; Avg_Frequency:f; Avg_Monetary:f; Focus_Buyer_Rate:f; Avg_Focus_Spend:f",
        lambda s, d, m=_m: R.score_cells(B.scored(s, d), m),
        f"""SELECT RFM_score_{_m}, count(*) AS Customers, {avg('Recency')} AS Avg_Recency, {avg('Frequency')} AS Avg_Frequency,
        {avg('Monetary')} AS Avg_Monetary, {avg('FocusBuyer')} AS Focus_Buyer_Rate, {avg('FocusSpend')} AS Avg_Focus_Spend
        FROM scored GROUP BY 1""", B.SCORED)
    add(f"rfm_{_name}_segment_counts", f"{_key}:s; n:i", lambda s, d, m=_m: R.segment_counts(B.scored(s, d), m),
        f"SELECT {_key}, count(*) AS n FROM scored GROUP BY 1", B.SCORED)
    _summary_sql = f"""SELECT {_key}, count(*) AS Customers,
        count(*)::DOUBLE / (SELECT count(*) FROM scored) AS Customer_Share, {avg('Recency')} AS Avg_Recency,
        {avg('Frequency')} AS Avg_Frequency, {avg('Monetary')} AS Avg_Monetary,
        median(CAST(Monetary AS DOUBLE)) AS Median_Monetary, sum(Monetary) AS Total_Monetary, sum(FocusBuyer) AS Focus_Buyers,
        {avg('FocusBuyer')} AS Focus_Buyer_Rate, {avg('FocusSpend')} AS Avg_Focus_Spend, median(Age) AS Median_Age,
        median(Income) AS Median_Income FROM scored GROUP BY 1"""
    add(f"rfm_{_name}_segment_summary",
        f"{_key}:s; Customers:i; Customer_Share:f; Avg_Recency:f; Avg_Frequency:f; Avg_Monetary:f; Median_Monetary:f; "
        "Total_Monetary:f; Focus_Buyers:i; Focus_Buyer_Rate:f; Avg_Focus_Spend:f; Median_Age:f; Median_Income:f",
        lambda s, d, m=_m: R.segment_summary(B.scored(s, d), m), _summary_sql, B.SCORED)
    add(f"rfm_{_name}_report",
        "Segment:s; Customers:i; Share:s; Avg recency (days):f; Avg frequency:f; Avg monetary (£):s; Focus buyer rate:s",
        lambda s, d, m=_m: R.segment_report(R.segment_summary(B.scored(s, d), m), m),
        f"""SELECT {_key} AS Segment, Customers, {percent_label_sql('Customer_Share')} AS Share,
        round(Avg_Recency, 1) AS "Avg recency (days)", round(Avg_Frequency, 2) AS "Avg frequency",
        {money_label_sql('Avg_Monetary')} AS "Avg monetary (£)", {percent_label_sql('Focus_Buyer_Rate')} AS "Focus buyer rate"
        FROM ({_summary_sql})""", B.SCORED)
    if _m == "ind":
        IND_SUMMARY_SQL = _summary_sql

add("rfm_method_comparison",
    "CustomerID:i; RFM_score_ind:s; RFM_total_ind:i; RFM_segment_ind:s; RFM_score_seq:s; RFM_total_seq:i; "
    "RFM_segment_seq:s; Same_Segment:b", lambda s, d: R.compare_methods(B.scored(s, d)),
    "SELECT *, RFM_segment_ind = RFM_segment_seq AS Same_Segment FROM scored", B.SCORED)
add("rfm_segment_crosstab", "RFM_segment_ind:s; " + "; ".join(f"{x}:i" for x in R.SEGMENTS),
    lambda s, d: R.crosstab(B.scored(s, d), "RFM_segment_ind", "RFM_segment_seq", R.SEGMENTS, R.SEGMENTS),
    "SELECT l.v AS RFM_segment_ind, " + ", ".join(
        f"""count(*) FILTER (WHERE RFM_segment_seq = '{x}') AS "{x}" """ for x in R.SEGMENTS)
    + f" FROM (SELECT unnest({R.SEGMENTS}) AS v) l LEFT JOIN scored ON RFM_segment_ind = l.v GROUP BY 1", B.SCORED)
_agree = B.SCORED + ", compared AS (SELECT *, RFM_segment_ind = RFM_segment_seq AS Same FROM scored)"
add("rfm_method_agreement", "Customers:i; Same_Segment_Count:i; Same_Segment_Rate:f",
    lambda s, d: R.method_agreement(R.compare_methods(B.scored(s, d))),
    """SELECT count(*) AS Customers, count(*) FILTER (WHERE Same) AS Same_Segment_Count,
       count(*) FILTER (WHERE Same)::DOUBLE / count(*) AS Same_Segment_Rate FROM compared""", _agree)
add("rfm_agreement_split", "Agreement_Status:s; n:i; Share:f; Label:s",
    lambda s, d: R.agreement_split(R.compare_methods(B.scored(s, d))),
    _split.format(key="CASE WHEN Same THEN 'Same segment' ELSE 'Different segment' END AS Agreement_Status",
                  src="compared", share="Share", pct=percent_label_sql("Share")), _agree)
add("rfm_profile_long", "RFM_segment_ind:s; Metric:s; Value:f",
    lambda s, d: R.profile_long(R.segment_summary(B.scored(s, d))),
    " UNION ALL ".join(
        f"SELECT RFM_segment_ind, 'Average {m.lower()}' AS Metric, {avg(m)} AS Value FROM scored GROUP BY 1"
        for m in ("Recency", "Frequency", "Monetary")), B.SCORED)
add("customer_data_rfm", FEATURES + "; " + _scores("ind") + "; " + _scores("seq"), lambda s, d: B.scored(s, d),
    "SELECT * FROM scored", B.SCORED)
add("customer_data_rfm_joined", FEATURES + "; " + _scores("ind") + "; " + _scores("seq"),
    lambda s, d: (lambda p: R.join_scores(p, R.score_independent(p), R.score_sequential(p)))(B.people(s, d)),
    "SELECT * FROM scored", B.SCORED)
add("rfm_method_facts",
    "Method:s; Champions:i; Largest_Segment:s; Largest_Customers:i; Largest_Share:f; Same_Segment_Count:i; Same_Segment_Rate:f",
    lambda s, d: R.method_comparison(R.compare_methods(B.scored(s, d))),
    " UNION ALL ".join(
        f"""SELECT '{name}' AS Method, (SELECT count(*) FROM compared WHERE RFM_segment_{m} = 'Champions') AS Champions,
        top.seg AS Largest_Segment, top.n AS Largest_Customers, top.n::DOUBLE / (SELECT count(*) FROM compared) AS Largest_Share,
        (SELECT count(*) FROM compared WHERE Same) AS Same_Segment_Count,
        (SELECT count(*) FILTER (WHERE Same)::DOUBLE / count(*) FROM compared) AS Same_Segment_Rate
        FROM (SELECT RFM_segment_{m} AS seg, count(*) AS n FROM compared GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) AS top"""
        for name, m in (("Independent", "ind"), ("Sequential", "seq"))), _agree)

# ------------------------------------------------------------------ chart tables


def _histogram_sql(column: str, width: float, edge: float, source: str = "people", group: str = "") -> str:
    key = f"{group}, " if group else ""
    return f"""SELECT {key}x_min, x_min + {width} AS x_max, count(*) AS n FROM (
      SELECT {key}o + (greatest(ceil((x - o) / {width}), 1) - 1) * {width} AS x_min FROM (
        SELECT {key}CAST({column} AS DOUBLE) AS x, (SELECT {edge} + floor((min(CAST({column} AS DOUBLE)) - {edge}) / {width}) * {width}
               FROM {source}) AS o FROM {source})) GROUP BY ALL"""


for _c, _expr in (("Monetary", "CAST(Monetary AS DOUBLE)"), ("LogMonetary", "ln(CAST(Monetary AS DOUBLE))")):
    add(f"histogram_{_c.lower()}", "bin:i; x_min:f; x_max:f; n:i",
        lambda s, d, c=_c: V.fixed_count_histogram(C.log_features(B.people(s, d)), c, 35),
        f"""SELECT bin, lo + (bin - 1.5) * w AS x_min, lo + (bin - 0.5) * w AS x_max,
        (SELECT count(*) FROM (SELECT ceil(({_expr} - lo) / w + 0.5) AS k FROM people) WHERE k = bin) AS n
        FROM (SELECT min({_expr}) AS lo, (max({_expr}) - min({_expr})) / 34 AS w FROM people), range(1, 36) AS r(bin)""", B.PEOPLE)
add("histogram_recency", "x_min:f; x_max:f; n:i", lambda s, d: V.fixed_width_histogram(B.people(s, d), "Recency", 10),
    _histogram_sql("Recency", 10.0, 5.0), B.PEOPLE)
add("histogram_focus_spend", "x_min:f; x_max:f; n:i",
    lambda s, d: V.fixed_width_histogram(B.people(s, d).where("FocusBuyer = 1"), "FocusSpend", 5000, boundary=0),
    _histogram_sql("FocusSpend", 5000.0, 0.0, "(SELECT * FROM people WHERE FocusBuyer = 1)"), B.PEOPLE)
for _c, _w in (("Income", 500.0), ("Age", 5.0)):
    add(f"histogram_{_c.lower()}_by_buyer", "BuyerGroup:s; x_min:f; x_max:f; n:i",
        lambda s, d, c=_c, w=_w: V.fixed_width_histogram(
            B.people(s, d).withColumn("BuyerGroup", C.buyer_group()), c, w, by=["BuyerGroup"]),
        _histogram_sql(_c, _w, _w / 2, "grouped", "BuyerGroup"),
        B.PEOPLE + """, grouped AS (SELECT *, CASE WHEN FocusBuyer = 1 THEN 'Focus buyer' ELSE 'Non-focus buyer' END
        AS BuyerGroup FROM people)""")
add("frequency_counts", "Frequency:i; n:i",
    lambda s, d: B.people(s, d).groupBy("Frequency").agg(F.count(F.lit(1)).alias("n")).orderBy("Frequency"),
    "SELECT Frequency, count(*) AS n FROM people GROUP BY 1", B.PEOPLE)


def _bars_sql(source: str, category: str, value: str, label: str) -> str:
    return f"""SELECT {category} AS Category, {value} AS Value, {label} AS Label,
      row_number() OVER (ORDER BY {value}, {category}) AS SortOrder FROM ({source})"""


BARS = "Category:s; Value:f; Label:s; SortOrder:i"


def _category_bars(s, d):
    from ..operators.quality import category_sales
    return V.currency_bars(category_sales(B.lines(s, d)), "ProductCategory", "TotalSales")


add("bars_category_sales", BARS, _category_bars,
    _bars_sql("SELECT ProductCategory, sum(TotalSpend) AS TotalSales FROM lines GROUP BY 1", "ProductCategory", "TotalSales",
              money_label_sql("TotalSales")), B.LINES)
add("bars_segment_value", BARS,
    lambda s, d: V.currency_bars(R.segment_summary(B.scored(s, d)), "RFM_segment_ind", "Avg_Monetary"),
    _bars_sql(IND_SUMMARY_SQL, "RFM_segment_ind", "Avg_Monetary", money_label_sql("Avg_Monetary")), B.SCORED)
for _n, _v in (("share", "Customer_Share"), ("buyer_rate", "Focus_Buyer_Rate")):
    add(f"bars_segment_{_n}", BARS,
        lambda s, d, v=_v: V.percent_bars(R.segment_summary(B.scored(s, d)), "RFM_segment_ind", v),
        _bars_sql(IND_SUMMARY_SQL, "RFM_segment_ind", _v, percent_label_sql(_v)), B.SCORED)

QUERIES, SQL = book.queries, book.sql
