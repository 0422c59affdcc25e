"""Shared inputs of the queries, as Spark frames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, quality, rfm
from ..session import settled, written
from ..sources import views

FOCUS_SQL = f"ProductCategory = '{views.FOCUS}'"
# the documented exclusion of the test views: the largest lines of one product
EXCLUDE_SQL = "(ProductID = 7 AND Quantity >= 25)"


def focus() -> Column:
    return features.focus_category(views.FOCUS)


def exclusion() -> Column:
    return (F.col("ProductID") == 7) & (F.col("Quantity") >= 25)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_transactions(spark, sf)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned lines."""
    line, *lookups = views.raw_tables(spark, sf)
    return quality.clean_transactions(line, lookups=lookups, join=views.joined)


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their features, written once for the steps of one query."""
    return settled(spark, lambda: features.customer_features(lines(spark, sf), focus()))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return written(rfm.score_both(people(spark, sf)))


CUSTOMERS_SQL = """
  SELECT c_custkey AS CustomerID,
         CASE WHEN c_custkey % 7 < 4 THEN 1 ELSE 0 END AS Married,
         n_regionkey AS HouseholdSize, c_acctbal AS Income, 18 + c_custkey % 63 AS Age,
         CAST(c_nationkey AS VARCHAR) AS ZipCode, c_mktsegment AS Work, c_custkey % 4 AS Education
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""

RETAIL = f"""people0 AS ({CUSTOMERS_SQL}),
retail AS (
  SELECT CustomerID, o_orderkey AS InvoiceNo, CAST(o_orderdate AS DATE) AS InvoiceDate, l_partkey AS ProductID,
         p_name AS ProductCategory, CAST(p_retailprice AS DECIMAL(12,2)) AS UnitPrice,
         CAST(l_quantity AS INT) AS Quantity, Married, HouseholdSize, Income, Age, ZipCode, Work, Education
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN people0 ON o_custkey = CustomerID)"""

RAW = RETAIL + """,
raw AS (
  SELECT * REPLACE (CASE WHEN ProductID % 50 = 0 THEN NULL ELSE ProductCategory END AS ProductCategory)
  FROM (SELECT * FROM retail UNION ALL SELECT * FROM retail WHERE InvoiceNo % 97 = 0))"""

LINES = RAW + """,
lines AS (
  SELECT DISTINCT *, CAST(UnitPrice * Quantity AS DECIMAL(18,2)) AS TotalSpend
  FROM raw WHERE ProductCategory IS NOT NULL)"""


def features_cte(name: str, source: str, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT *, CAST(Monetary AS DOUBLE) / Frequency AS AvgBasketValue,
         CASE WHEN FocusSpend > 0 THEN 1 ELSE 0 END AS FocusBuyer,
         CASE WHEN Monetary = 0 THEN 0 ELSE CAST(FocusSpend AS DOUBLE) / CAST(Monetary AS DOUBLE) END AS FocusShare
  FROM (SELECT CustomerID, min(InvoiceDate) AS first_purchase_date, max(InvoiceDate) AS last_purchase_date,
               (SELECT max(InvoiceDate) + 1 FROM {source} WHERE {where}) - max(InvoiceDate) AS Recency,
               count(DISTINCT InvoiceNo) AS Frequency, sum(TotalSpend) AS Monetary, sum(Quantity) AS TotalQuantity,
               count(DISTINCT ProductCategory) AS CategoryDiversity, count(DISTINCT ProductID) AS ProductDiversity,
               coalesce(sum(TotalSpend) FILTER (WHERE {FOCUS_SQL}), 0) AS FocusSpend,
               coalesce(sum(Quantity) FILTER (WHERE {FOCUS_SQL}), 0) AS FocusQuantity,
               count(DISTINCT InvoiceNo) FILTER (WHERE {FOCUS_SQL}) AS FocusInvoices,
               min(Married) AS Married, min(HouseholdSize) AS HouseholdSize, min(Income) AS Income, min(Age) AS Age,
               min(ZipCode) AS ZipCode, min(Work) AS Work, min(Education) AS Education
        FROM {source} WHERE {where} GROUP BY CustomerID))"""


PEOPLE = LINES + ",\n" + features_cte("people", "lines")


def segment_sql(m: str) -> str:
    r, f, v = f"R_score_{m}", f"F_score_{m}", f"M_score_{m}"
    total = f"({r} + {f} + {v})"
    return f"""CASE WHEN {r} >= 4 AND {f} >= 4 AND {v} >= 4 THEN 'Champions'
       WHEN {r} >= 4 AND {f} >= 3 AND {v} >= 3 THEN 'Loyal high-value'
       WHEN {r} >= 4 AND {f} <= 2 THEN 'Recent low-frequency'
       WHEN {r} <= 2 AND {f} >= 4 AND {v} >= 4 THEN 'At-risk high-value'
       WHEN {r} <= 2 AND {f} <= 2 AND {v} <= 2 THEN 'Low-value inactive'
       WHEN {total} >= 11 THEN 'Promising' WHEN {total} >= 8 THEN 'Moderate'
       WHEN {total} >= 5 THEN 'Needs attention' ELSE 'Low priority' END"""


def _method_columns(m: str) -> str:
    return (f"concat(R_score_{m}, F_score_{m}, M_score_{m}) AS RFM_score_{m}, "
            f"R_score_{m} + F_score_{m} + M_score_{m} AS RFM_total_{m}, {segment_sql(m)} AS RFM_segment_{m}")


SCORED = PEOPLE + f""",
scored0 AS (
  SELECT *, ntile(5) OVER (ORDER BY Recency DESC, CustomerID) AS R_score_ind,
         ntile(5) OVER (ORDER BY Frequency, CustomerID) AS F_score_ind,
         ntile(5) OVER (ORDER BY Monetary, CustomerID) AS M_score_ind,
         ntile(5) OVER (ORDER BY Recency DESC, CustomerID) AS R_score_seq FROM people),
scored1 AS (SELECT *, ntile(5) OVER (PARTITION BY R_score_seq ORDER BY Frequency, CustomerID) AS F_score_seq FROM scored0),
scored2 AS (SELECT *, ntile(5) OVER (PARTITION BY R_score_seq, F_score_seq ORDER BY Monetary, CustomerID) AS M_score_seq
            FROM scored1),
scored AS (SELECT *, {_method_columns('ind')}, {_method_columns('seq')} FROM scored2)"""


def avg_sql(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / count({column})"
