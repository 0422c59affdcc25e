"""Queries on transaction lines: quality, cleaning, outliers."""

from __future__ import annotations

import uuid

from ..operators import outliers as U
from ..operators import quality as Q
from ..operators.rank import exact_quantiles
from ..session import shared_folder, written
from ..sources import readers, views
from ..sources.writers import write_csv
from . import base as B
from .shape import Book

book = Book()
add = book.add

RAW_COLUMNS = ["CustomerID", "InvoiceNo", "InvoiceDate", "ProductID", "ProductCategory", "UnitPrice", "Quantity",
               "Married", "HouseholdSize", "Income", "Age", "ZipCode", "Work", "Education"]
LINE = ("InvoiceNo:i; InvoiceDate:d; CustomerID:i; ProductID:i; ProductCategory:s; UnitPrice:f; Quantity:i; TotalSpend:f")


def _missing_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS Variable, count(*) FILTER (WHERE {c} IS NULL) AS Missing_Count FROM {source}" for c in columns)


add("missing_profile", "Variable:s; Missing_Count:i", lambda s, d: Q.missing_profile(B.raw(s, d)),
    _missing_sql("raw", RAW_COLUMNS), B.RAW)
add("missing_profile_clean", "Variable:s; Missing_Count:i", lambda s, d: Q.missing_profile(B.lines(s, d)),
    _missing_sql("lines", RAW_COLUMNS + ["TotalSpend"]), B.LINES)
add("missing_profile_prospects", "Variable:s; Missing_Count:i", lambda s, d: Q.missing_profile(views.prospects(s, d)),
    _missing_sql("(SELECT * FROM people0 WHERE CustomerID % 5 = 0)", ["CustomerID"] + RAW_COLUMNS[7:]), B.RETAIL)
add("duplicate_count", "n_duplicates:i", lambda s, d: Q.duplicate_count(B.raw(s, d)),
    "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS n_duplicates", B.RAW)
add("duplicate_count_prospects", "n_duplicates:i", lambda s, d: Q.duplicate_count(views.prospects(s, d)),
    """SELECT (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS n_duplicates""",
    B.RETAIL + ", p AS (SELECT * FROM people0 WHERE CustomerID % 5 = 0)")
add("cardinality_profile",
    "rows:i; unique_customers:i; unique_invoices:i; unique_products:i; unique_categories:i",
    lambda s, d: Q.cardinality_profile(B.raw(s, d), {
        "unique_customers": "CustomerID", "unique_invoices": "InvoiceNo", "unique_products": "ProductID",
        "unique_categories": "ProductCategory"}),
    """SELECT count(*) AS rows, count(DISTINCT CustomerID) AS unique_customers,
       count(DISTINCT InvoiceNo) AS unique_invoices, count(DISTINCT ProductID) AS unique_products,
       count(DISTINCT coalesce(ProductCategory, '<missing>')) AS unique_categories FROM raw""", B.RAW)
add("range_profile",
    "; ".join(f"{m}_{c}:f" for c in ("unit_price", "quantity", "income", "age") for m in ("min", "max")),
    lambda s, d: Q.range_profile(B.raw(s, d), {
        "unit_price": "UnitPrice", "quantity": "Quantity", "income": "Income", "age": "Age"}),
    """SELECT min(UnitPrice) AS min_unit_price, max(UnitPrice) AS max_unit_price, min(Quantity) AS min_quantity,
       max(Quantity) AS max_quantity, min(Income) AS min_income, max(Income) AS max_income, min(Age) AS min_age,
       max(Age) AS max_age FROM raw""", B.RAW)
add("category_counts", "ProductCategory:s; n:i", lambda s, d: Q.value_counts(B.raw(s, d), "ProductCategory"),
    "SELECT ProductCategory, count(*) AS n FROM raw GROUP BY 1", B.RAW)
add("nonpositive_profile", "zero_or_negative_price:i; zero_or_negative_quantity:i; zero_or_negative_spend:i",
    lambda s, d: Q.nonpositive_profile(
        B.lines(s, d).selectExpr("UnitPrice - 905 AS UnitPrice", "Quantity - 3 AS Quantity",
                                 "(UnitPrice - 905) * (Quantity - 3) AS TotalSpend")),
    """SELECT count(*) FILTER (WHERE UnitPrice - 905 <= 0) AS zero_or_negative_price,
       count(*) FILTER (WHERE Quantity - 3 <= 0) AS zero_or_negative_quantity,
       count(*) FILTER (WHERE (UnitPrice - 905) * (Quantity - 3) <= 0) AS zero_or_negative_spend FROM lines""", B.LINES)
add("clean_transactions", LINE, lambda s, d: B.lines(s, d), "SELECT * FROM lines", B.LINES)
add("exclude_rows", LINE, lambda s, d: Q.exclude_rows(B.lines(s, d), B.exclusion()),
    f"SELECT * FROM lines WHERE NOT {B.EXCLUDE_SQL}", B.LINES)
add("cleaning_summary",
    "Rows_Before:i; Rows_After:i; Rows_Removed:i; Customers_Before:i; Customers_After:i; Sales_Before:f; Sales_After:f; "
    "Sales_Removed:f; Focus_Spend_Before:f; Focus_Spend_After:f; Focus_Spend_Removed:f",
    lambda s, d: Q.cleaning_summary(B.lines(s, d), B.exclusion(), B.focus()),
    f"""SELECT *, Rows_Before - Rows_After AS Rows_Removed, Sales_Before - Sales_After AS Sales_Removed,
       Focus_Spend_Before - Focus_Spend_After AS Focus_Spend_Removed FROM (
       SELECT count(*) AS Rows_Before, count(*) FILTER (WHERE NOT {B.EXCLUDE_SQL}) AS Rows_After,
       count(DISTINCT CustomerID) AS Customers_Before,
       count(DISTINCT CustomerID) FILTER (WHERE NOT {B.EXCLUDE_SQL}) AS Customers_After,
       sum(TotalSpend) AS Sales_Before, sum(TotalSpend) FILTER (WHERE NOT {B.EXCLUDE_SQL}) AS Sales_After,
       sum(TotalSpend) FILTER (WHERE {B.FOCUS_SQL}) AS Focus_Spend_Before,
       sum(TotalSpend) FILTER (WHERE {B.FOCUS_SQL} AND NOT {B.EXCLUDE_SQL}) AS Focus_Spend_After FROM lines)""", B.LINES)
add("transaction_summary",
    "rows:i; unique_customers:i; unique_invoices:i; unique_products:i; unique_categories:i; total_sales:f; "
    "average_line_spend:f; median_line_spend:f; max_quantity:i; max_line_spend:f",
    lambda s, d: Q.transaction_summary(B.lines(s, d)),
    f"""SELECT count(*) AS rows, count(DISTINCT CustomerID) AS unique_customers,
       count(DISTINCT InvoiceNo) AS unique_invoices, count(DISTINCT ProductID) AS unique_products,
       count(DISTINCT ProductCategory) AS unique_categories, sum(TotalSpend) AS total_sales,
       {B.avg_sql('TotalSpend')} AS average_line_spend, median(CAST(TotalSpend AS DOUBLE)) AS median_line_spend,
       max(Quantity) AS max_quantity, max(TotalSpend) AS max_line_spend FROM lines""", B.LINES)
add("top_lines", LINE, lambda s, d: Q.top_lines(B.lines(s, d), 20),
    "SELECT * FROM lines ORDER BY TotalSpend DESC, CustomerID, InvoiceNo, ProductID, Quantity LIMIT 20", B.LINES)
add("category_sales", "ProductCategory:s; TotalSales:f; CategoryRank:i", lambda s, d: Q.category_sales(B.lines(s, d)),
    """SELECT *, row_number() OVER (ORDER BY TotalSales DESC, ProductCategory) AS CategoryRank
       FROM (SELECT ProductCategory, sum(TotalSpend) AS TotalSales FROM lines GROUP BY 1)""", B.LINES)
add("category_position", "Category:s; CategorySales:f; CategoryRank:i",
    lambda s, d: Q.category_position(B.lines(s, d), views.FOCUS),
    f"""SELECT ProductCategory AS Category, TotalSales AS CategorySales, CategoryRank FROM (
       SELECT *, row_number() OVER (ORDER BY TotalSales DESC, ProductCategory) AS CategoryRank
       FROM (SELECT ProductCategory, sum(TotalSpend) AS TotalSales FROM lines GROUP BY 1)) WHERE {B.FOCUS_SQL}""", B.LINES)
add("table_structure", "position:i; column_name:s; type:s; row_count:i; column_count:i",
    lambda s, d: readers.describe_table(readers.read_table(s, d, "customer")),
    """SELECT position, column_name, type, (SELECT count(*) FROM customer) AS row_count, 5 AS column_count FROM
       (VALUES (0,'c_custkey','bigint'),(1,'c_name','string'),(2,'c_nationkey','int'),(3,'c_acctbal','double'),
               (4,'c_mktsegment','string')) AS t(position, column_name, type)""")
add("numeric_summary", "Variable:s; min:f; q1:f; median:f; q3:f; mean:f; max:f; sd:f",
    lambda s, d: readers.numeric_summary(B.lines(s, d), ["UnitPrice", "Quantity", "Income"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS Variable, min({c}) AS min, avg(CAST({c} AS DOUBLE)) AS mean, max({c}) AS max,
        quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
        quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, stddev_samp(CAST({c} AS DOUBLE)) AS sd FROM lines""" for c in ("UnitPrice", "Quantity", "Income")), B.LINES)

# ------------------------------------------------------------------ outliers

_QC = "quantile_cont(CAST({c} AS DOUBLE), {p})"
THRESHOLDS = B.LINES + """,
cuts AS (SELECT quantile_cont(CAST(Quantity AS DOUBLE), 0.99) AS q99, quantile_cont(CAST(Quantity AS DOUBLE), 0.999) AS q999,
         quantile_cont(CAST(TotalSpend AS DOUBLE), 0.99) AS s99, quantile_cont(CAST(TotalSpend AS DOUBLE), 0.999) AS s999
         FROM lines),
flagged AS (SELECT lines.*, Quantity > q99 AS Quantity_Outlier_99, CAST(TotalSpend AS DOUBLE) > s99 AS Spend_Outlier_99,
            Quantity > q999 AS Quantity_Outlier_999, CAST(TotalSpend AS DOUBLE) > s999 AS Spend_Outlier_999
            FROM lines CROSS JOIN cuts WHERE Quantity > q99 OR CAST(TotalSpend AS DOUBLE) > s99)"""

add("outlier_thresholds", "Threshold:s; Quantity:f; TotalSpend:f", lambda s, d: U.percentile_thresholds(B.lines(s, d)),
    " UNION ALL ".join(
        f"SELECT '{t}th percentile' AS Threshold, {_QC.format(c='Quantity', p=p)} AS Quantity, "
        f"{_QC.format(c='TotalSpend', p=p)} AS TotalSpend FROM lines"
        for t, p in (("99", 0.99), ("99.5", 0.995), ("99.9", 0.999))), B.LINES)
add("flag_outliers", LINE + "; Quantity_Outlier_99:b; Spend_Outlier_99:b; Quantity_Outlier_999:b; Spend_Outlier_999:b",
    lambda s, d: U.flag_outliers(B.lines(s, d)), "SELECT * FROM flagged", THRESHOLDS)
add("outlier_summary", "Outlier_Rows:i; Unique_Customers:i; Total_Outlier_Spend:f; Share_of_Total_Sales:f",
    lambda s, d: (lambda x: U.outlier_summary(U.flag_outliers(x), x))(written(B.lines(s, d))),
    """SELECT count(*) AS Outlier_Rows, count(DISTINCT CustomerID) AS Unique_Customers, sum(TotalSpend) AS Total_Outlier_Spend,
       CAST(sum(TotalSpend) AS DOUBLE) / CAST((SELECT sum(TotalSpend) FROM lines) AS DOUBLE) AS Share_of_Total_Sales
       FROM flagged""", THRESHOLDS)
add("outlier_review", LINE, lambda s, d: U.outlier_review(U.flag_outliers(B.lines(s, d)), 30),
    "SELECT * FROM flagged ORDER BY TotalSpend DESC, CustomerID, InvoiceNo, ProductID, Quantity LIMIT 30", THRESHOLDS)
add("quantiles_by_slices", "Variable:s; p:f; value:f",
    lambda s, d: exact_quantiles(B.lines(s, d), ["Quantity", "TotalSpend"], [0.01, 0.25, 0.5, 0.9, 0.999], bits=16),
    " UNION ALL ".join(f"SELECT '{c}' AS Variable, {p} AS p, {_QC.format(c=c, p=p)} AS value FROM lines"
                       for c in ("Quantity", "TotalSpend") for p in (0.01, 0.25, 0.5, 0.9, 0.999)), B.LINES)
add("quantiles_by_group", "ProductID:i; p:f; value:f",
    lambda s, d: exact_quantiles(B.lines(s, d), ["TotalSpend"], [0.5, 0.99], ["ProductID"]),
    " UNION ALL ".join(f"SELECT ProductID, {p} AS p, {_QC.format(c='TotalSpend', p=p)} AS value FROM lines GROUP BY 1"
                       for p in (0.5, 0.99)), B.LINES)
add("outlier_by_category", "ProductCategory:s; Outlier_Rows:i; Outlier_Spend:f; Max_Quantity:i; Max_Line_Spend:f",
    lambda s, d: U.outlier_by_category(U.flag_outliers(B.lines(s, d))),
    """SELECT ProductCategory, count(*) AS Outlier_Rows, sum(TotalSpend) AS Outlier_Spend, max(Quantity) AS Max_Quantity,
       max(TotalSpend) AS Max_Line_Spend FROM flagged GROUP BY 1""", THRESHOLDS)
add("trim_percentile", LINE, lambda s, d: U.trim_percentile(B.lines(s, d), "TotalSpend", 0.01, 0.99),
    """SELECT lines.* FROM lines CROSS JOIN (SELECT quantile_cont(CAST(TotalSpend AS DOUBLE), 0.01) AS lo,
       quantile_cont(CAST(TotalSpend AS DOUBLE), 0.99) AS hi FROM lines) WHERE CAST(TotalSpend AS DOUBLE) BETWEEN lo AND hi""",
    B.LINES)
add("sensitivity_summary",
    "Version:s; Customers:i; Total_Sales:f; Mean_Monetary:f; Median_Monetary:f; Max_Monetary:f; Total_Focus_Spend:f; "
    "Mean_Focus_Spend:f; Median_Focus_Spend_Buyers:f; Max_Focus_Spend:f",
    lambda s, d: U.sensitivity_summary(B.lines(s, d), B.exclusion(), B.focus()),
    " UNION ALL ".join(
        f"""SELECT '{v}' AS Version, count(*) AS Customers, sum(Monetary) AS Total_Sales,
        {B.avg_sql('Monetary')} AS Mean_Monetary, median(CAST(Monetary AS DOUBLE)) AS Median_Monetary,
        max(Monetary) AS Max_Monetary, sum(FocusSpend) AS Total_Focus_Spend, {B.avg_sql('FocusSpend')} AS Mean_Focus_Spend,
        median(CAST(FocusSpend AS DOUBLE)) FILTER (WHERE FocusBuyer = 1) AS Median_Focus_Spend_Buyers,
        max(FocusSpend) AS Max_Focus_Spend FROM {t}""" for v, t in (("With", "people"), ("Without", "people_without"))),
    B.PEOPLE + ",\n" + B.features_cte("people_without", "lines", f"NOT {B.EXCLUDE_SQL}"))

# ------------------------------------------------------------------ files


def _round_trip(spark, df, **options):
    """``df`` written as CSV to a folder of the shared one and read back under its schema."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(df, folder, **options)
    return readers.read_csv(spark, folder, df.schema)


for _name, _options in (("csv_round_trip", {}), ("csv_quoted_round_trip", {"quote_text": True})):
    add(_name, "CustomerID:i; Married:i; HouseholdSize:i; Income:f; Age:i; ZipCode:s; Work:s; Education:i",
        lambda s, d, o=_options: _round_trip(s, views.customers(s, d), **o),
        "SELECT * FROM people0", B.RETAIL)

QUERIES, SQL = book.queries, book.sql
