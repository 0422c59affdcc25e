"""Queries on clusters.

The fitted K-means and Ward results depend on a seed, so they carry no SQL. Everything that
follows from a cluster column is also run on a column SQL can form: the monetary score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import presets
from ..operators import anova as A
from ..operators import charts as V
from ..operators import clustering as K
from ..operators import features as C
from ..operators import rfm as R
from ..session import written
from ..sources import views
from . import base as B
from . import solve
from .customers import BARS, IND_SUMMARY_SQL, _bars_sql, money_label_sql, percent_label_sql  # noqa: F401
from .shape import Book

book = Book()
add = book.add
avg = B.avg_sql
X = presets.CLUSTER_VARIABLES
STARTS = 50


def base_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.log_features(B.scored(spark, sf))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return K.keep(K.standardise(K.cluster_matrix(base_table(spark, sf))))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The standardised vectors alone: fits need no scores."""
    return K.keep(K.standardise(K.cluster_matrix(C.log_features(B.people(spark, sf)))).select(
        "CustomerID", "Monetary", K.SCALED))


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted K-means clusters, numbered by falling value."""
    x = scaled(spark, sf)
    model, _ = K.kmeans_best_of(x, 4, STARTS)
    return K.renumber_by_value(K.attach_clusters(x, model))


def tiered(spark: SparkSession, sf: str) -> DataFrame:
    """The scored customers with the monetary score in the place of a cluster number."""
    return B.scored(spark, sf).withColumns({
        "KMeans_Cluster": F.col("M_score_ind"), "Hierarchical_Cluster": F.col("F_score_ind")})


TIERED = B.SCORED + ", tiered AS (SELECT *, M_score_ind AS KMeans_Cluster, F_score_ind AS Hierarchical_Cluster FROM scored)"

LOGS = B.PEOPLE + """, logs AS (SELECT *, ln(CAST(Monetary AS DOUBLE)) AS LogMonetary, ln(AvgBasketValue) AS LogAvgBasketValue,
  ln(TotalQuantity) AS LogTotalQuantity, ln(1 + CAST(FocusSpend AS DOUBLE)) AS LogFocusSpend,
  ln(1 + FocusQuantity) AS LogFocusQuantity FROM people)"""

add("cluster_missing_check", "Customers:i; Missing_Values:i", lambda s, d: K.missing_check(base_table(s, d), X),
    "SELECT count(*) AS Customers, " + " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in X)
    + " AS Missing_Values FROM logs", LOGS)
add("cluster_scaled_summary", "Variable:s; min:f; q1:f; median:f; q3:f; mean:f; max:f; sd:f", lambda s, d: K.scaled_summary(scaled(s, d), X),
    " UNION ALL ".join(
        f"""SELECT '{x}' AS Variable, min(z) AS min, quantile_cont(z, 0.25) AS q1, median(z) AS median, quantile_cont(z, 0.75) AS q3,
        avg(z) AS mean, max(z) AS max, stddev_samp(z) AS sd FROM
        (SELECT (CAST({x} AS DOUBLE) - avg(CAST({x} AS DOUBLE)) OVER ()) / stddev_samp(CAST({x} AS DOUBLE)) OVER () AS z FROM logs)"""
        for x in X), LOGS)
add("kmeans_elbow", None, lambda s, d: K.elbow(features(s, d), len(X)))
add("kmeans_restart_stability", None, lambda s, d: K.restart_stability(features(s, d), len(X)))


def _fit_summary(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d)
    return K.fit_summary(s, 4, K.kmeans_best_of(x, 4, STARTS)[1], K.total_sum_of_squares(x, len(X)))


add("kmeans_fit_summary", None, _fit_summary)
add("kmeans_clusters", None, lambda s, d: clustered(s, d).select("CustomerID", "KMeans_Cluster"))
add("kmeans_cluster_profile", None, lambda s, d: K.cluster_profile(clustered(s, d)))
add("ward_clusters", None, lambda s, d: K.ward_clusters(features(s, d), 4)[0].select("CustomerID", "Hierarchical_Cluster"))
add("ward_merge_heights", None, lambda s, d: K.ward_clusters(features(s, d), 4)[1].heights(s))
add("kmeans_ward_crosstab", None, lambda s, d: K.cluster_crosstab(
    K.ward_clusters(K.keep(clustered(s, d)), 4)[0], 4))

# Fits depend on their seeds, but these figures do not: SQL knows them without a fit.


def _fit_check(s: SparkSession, d: str) -> DataFrame:
    x = features(s, d)
    fit, _ = K.kmeans_best_of(x, 4, STARTS)
    return K.fit_check(K.attach_clusters(x, fit), fit, len(X))


def _steps(table: DataFrame, order: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of a small table and how often its within sum of squares rises."""
    before = F.lag("Total_Within_SS").over(W.orderBy(order))
    rises = table.withColumn("up", F.col("Total_Within_SS") > before * (1 + tolerance))
    return rises.agg(F.count(F.lit(1)).alias("Steps"), F.count_if("up").alias("Rises"), F.max("Total_Within_SS").alias("Largest"))


def _one_variable(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(K.kmeans_best_of(_log_value(s, d), 2, STARTS)[1],)], "Total_Within_SS double")


def _log_value(s: SparkSession, d: str) -> DataFrame:
    return K.keep(K.standardise(K.cluster_matrix(C.log_features(B.people(s, d)), ["LogMonetary"])).select("CustomerID", K.SCALED))


def _moves(s: SparkSession, d: str) -> DataFrame:
    """Four moves of two variables from the four customers of lowest number."""
    customers = C.log_features(B.people(s, d))
    x = K.keep(K.standardise(K.cluster_matrix(customers, ["LogMonetary", "Recency"])).select("CustomerID", K.SCALED))
    return K.moves_from(x, [r[K.SCALED].toArray() for r in x.orderBy("CustomerID").limit(4).collect()], 4)


def _ward_check(s: SparkSession, d: str) -> DataFrame:
    """Ward on the brands, where every row is its own micro-cluster."""
    x = K.keep(K.standardise(K.cluster_matrix(written(views.products(s, d)), views.PRODUCT_VARIABLES)))
    heights = K.ward_clusters(x, 4)[1].heights(s)
    falls = F.col("height") < F.lag("height").over(W.orderBy("step")) * (1 - 1e-9)
    return heights.withColumn("down", falls).agg(
        F.count(F.lit(1)).alias("Merges"), (F.sum(F.col("height") * F.col("height")) / 2).alias("Height_SS"),
        F.count_if("down").alias("Falls"), F.min("height").alias("First_Height"))


def _ward_sizes(s: SparkSession, d: str) -> DataFrame:
    return K.cluster_sizes(K.ward_clusters(features(s, d), 4)[0], "Hierarchical_Cluster")


_total = f"(count(*) - 1) * {len(X)}"
add("kmeans_fit_check", "Customers:i; Clusters:i; Total_SS:f4; SS_Gap:f4; Cost_Gap:f4; Off_Centre:f4", _fit_check,
    f"SELECT count(*) AS Customers, 4 AS Clusters, {_total} AS Total_SS, 0 AS SS_Gap, 0 AS Cost_Gap, 0 AS Off_Centre FROM logs", LOGS)
add("kmeans_ladder_check", "Steps:i; Rises:i", lambda s, d: _steps(K.restart_stability(features(s, d), len(X)), "Nstart"),
    "SELECT 6 AS Steps, 0 AS Rises FROM logs LIMIT 1", LOGS)
add("kmeans_elbow_check", "Steps:i; Rises:i; Largest:f4", lambda s, d: _steps(K.elbow(features(s, d), len(X)), "K"),
    f"SELECT 10 AS Steps, 0 AS Rises, {_total} AS Largest FROM logs", LOGS)
add("kmeans_best_split", "Total_Within_SS:f4", _one_variable, """SELECT min(s2 - s * s / i + (t2 - s2) - (t - s) * (t - s) / (n - i))
    AS Total_Within_SS FROM (SELECT row_number() OVER o AS i, count(*) OVER () AS n, sum(z) OVER o AS s, sum(z * z) OVER o AS s2,
    sum(z) OVER () AS t, sum(z * z) OVER () AS t2 FROM (SELECT CustomerID,
    (LogMonetary - avg(LogMonetary) OVER ()) / stddev_samp(LogMonetary) OVER () AS z FROM logs)
    WINDOW o AS (ORDER BY z, CustomerID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE i < n""", LOGS)
_zs = ", ".join(f"({v} - avg(CAST({v} AS DOUBLE)) OVER ()) / stddev_samp(CAST({v} AS DOUBLE)) OVER () AS {z}"
                for v, z in (("LogMonetary", "z1"), ("Recency", "z2")))
MOVES = LOGS + f""", z AS (SELECT CustomerID, {_zs} FROM logs),
centres0 AS (SELECT row_number() OVER (ORDER BY CustomerID) AS c, z1 AS m1, z2 AS m2 FROM z QUALIFY c <= 4)""" + "".join(f""",
near{i} AS (SELECT CustomerID, z1, z2, c, (z1 - m1) * (z1 - m1) + (z2 - m2) * (z2 - m2) AS d FROM z, centres{i}
  QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY d, c) = 1),
centres{i + 1} AS (SELECT c, avg(z1) AS m1, avg(z2) AS m2 FROM near{i} GROUP BY c)""" for i in range(5))
add("kmeans_moves_from_given_centres", "Cluster:i; Customers:i; Centre:f4; Within_SS:f4", _moves,
    """SELECT c AS Cluster, count(*) AS Customers, unnest([any_value(m1), any_value(m2)]) AS Centre, sum(d) AS Within_SS
    FROM near4 JOIN centres4 USING (c) GROUP BY c""", MOVES)
add("kmeans_elbow_one_variable", "K:i; Total_Within_SS:f4; WSS_Reduction:f4; Percent_Reduction:f",
    lambda s, d: K.elbow(_log_value(s, d), 1, (1, 2, 3)), """
    SELECT K, Total_Within_SS, lag(Total_Within_SS) OVER (ORDER BY K) - Total_Within_SS AS WSS_Reduction,
           1 - Total_Within_SS / lag(Total_Within_SS) OVER (ORDER BY K) AS Percent_Reduction FROM (
      SELECT 1 AS K, t2 - t * t / n AS Total_Within_SS FROM split WHERE i = n
      UNION ALL SELECT 2, min(s2 - s * s / i + t2 - s2 - (t - s) * (t - s) / (n - i)) FROM split WHERE i < n
      UNION ALL SELECT 3, min(a.s2 - a.s * a.s / a.i + b.s2 - a.s2 - (b.s - a.s) * (b.s - a.s) / (b.i - a.i)
                              + b.t2 - b.s2 - (b.t - b.s) * (b.t - b.s) / (b.n - b.i))
        FROM split AS a JOIN split AS b ON a.i < b.i WHERE b.i < b.n)""", LOGS + """,
z AS (SELECT CustomerID, (LogMonetary - avg(LogMonetary) OVER ()) / stddev_samp(LogMonetary) OVER () AS z FROM logs),
split AS (SELECT row_number() OVER o AS i, count(*) OVER () AS n, sum(z) OVER o AS s, sum(z * z) OVER o AS s2,
  sum(z) OVER () AS t, sum(z * z) OVER () AS t2 FROM z WINDOW o AS (ORDER BY z, CustomerID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
add("ward_cluster_sizes", None, _ward_sizes)
add("ward_size_check", "Customers:i; Clusters:i",
    lambda s, d: _ward_sizes(s, d).agg(F.sum("n").alias("Customers"), F.count(F.lit(1)).alias("Clusters")),
    "SELECT count(*) AS Customers, 4 AS Clusters FROM logs", LOGS)

add("cluster_sizes", "KMeans_Cluster:i; n:i; Share:f; Label:s", lambda s, d: K.cluster_sizes(tiered(s, d)),
    f"""SELECT *, concat(n, chr(10), '(', {percent_label_sql('Share')}, ')') AS Label FROM
    (SELECT KMeans_Cluster, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM tiered) AS Share FROM tiered GROUP BY 1)""",
    TIERED)
add("cluster_crosstab", "KMeans_Cluster:i; " + "; ".join(f"{i}:i" for i in range(1, 6)),
    lambda s, d: K.cluster_crosstab(tiered(s, d), 5),
    "SELECT KMeans_Cluster, " + ", ".join(f'count(*) FILTER (WHERE Hierarchical_Cluster = {i}) AS "{i}"' for i in range(1, 6))
    + " FROM tiered GROUP BY 1", TIERED)
_means = {"Avg_Recency": "Recency", "Avg_Frequency": "Frequency", "Avg_Monetary": "Monetary",
          "Avg_Basket_Value": "AvgBasketValue", "Avg_Category_Diversity": "CategoryDiversity",
          "Avg_Product_Diversity": "ProductDiversity", "Focus_Buyer_Rate": "FocusBuyer", "Avg_Focus_Spend": "FocusSpend",
          "Avg_Focus_Share": "FocusShare", "Avg_RFM_Total": "RFM_total_ind"}
_medians = {"Median_Recency": "Recency", "Median_Frequency": "Frequency", "Median_Monetary": "Monetary",
            "Median_Focus_Spend": "FocusSpend", "Median_Age": "Age", "Median_Income": "Income",
            "Median_Household_Size": "HouseholdSize"}
PROFILE_SQL = ("SELECT KMeans_Cluster, count(*) AS Customers, count(*)::DOUBLE / (SELECT count(*) FROM tiered) AS Customer_Share, "
               + ", ".join(f"{avg(c)} AS {k}" for k, c in _means.items()) + ", "
               + ", ".join(f"median(CAST({c} AS DOUBLE)) AS {k}" for k, c in _medians.items())
               + ", sum(Monetary) AS Total_Monetary, sum(FocusBuyer) AS Focus_Buyers FROM tiered GROUP BY 1")
PROFILE = "KMeans_Cluster:i; Customers:i; Customer_Share:f; " + "; ".join(
    f"{k}:f" for k in (*_means, *_medians)) + "; Total_Monetary:f; Focus_Buyers:i"
add("cluster_profile", PROFILE, lambda s, d: K.cluster_profile(tiered(s, d)), PROFILE_SQL, TIERED)
MIX_SQL = """SELECT *, Customers::DOUBLE / sum(Customers) OVER (PARTITION BY KMeans_Cluster) AS Cluster_Share FROM
  (SELECT KMeans_Cluster, RFM_segment_ind, count(*) AS Customers FROM tiered GROUP BY ALL)"""
add("cluster_rfm_mix", "KMeans_Cluster:i; RFM_segment_ind:s; Customers:i; Cluster_Share:f",
    lambda s, d: K.cluster_segment_mix(tiered(s, d)), MIX_SQL, TIERED)
add("cluster_rfm_mix_wide", "KMeans_Cluster:i; " + "; ".join(f"{x}:i" for x in R.SEGMENTS),
    lambda s, d: K.cluster_segment_mix_wide(K.cluster_segment_mix(tiered(s, d)), R.SEGMENTS),
    "SELECT KMeans_Cluster, " + ", ".join(f"""count(*) FILTER (WHERE RFM_segment_ind = '{x}') AS "{x}" """ for x in R.SEGMENTS)
    + " FROM tiered GROUP BY 1", TIERED)
add("cluster_heatmap", "KMeans_Cluster:i; Metric:s; Standardised_Value:f", lambda s, d: K.cluster_heatmap(tiered(s, d)),
    " UNION ALL ".join(
        f"""SELECT KMeans_Cluster, '{k}' AS Metric, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS Standardised_Value FROM
        (SELECT KMeans_Cluster, {avg(c)} AS m FROM tiered GROUP BY 1)""" for k, c in K.HEATMAP_MEASURES.items()), TIERED)
_labels = presets.cluster_labels()
LABELS = TIERED + f""",
means AS (SELECT KMeans_Cluster, {avg('FocusBuyer')} AS rate, {avg('Monetary')} AS m, {avg('Recency')} AS r FROM tiered GROUP BY 1),
sides AS (SELECT *, rate > (SELECT {avg('FocusBuyer')} FROM tiered) AS focused FROM means),
ranked AS (SELECT *, row_number() OVER (PARTITION BY focused ORDER BY CASE WHEN focused THEN m ELSE r END DESC, KMeans_Cluster) AS k
           FROM sides),
labels AS (SELECT KMeans_Cluster, CASE WHEN focused AND k = 1 THEN 'loyal' WHEN focused THEN 'committed'
           WHEN k = 1 THEN 'inactive' ELSE 'general' END AS Role FROM ranked),
named AS (SELECT *, CASE Role {' '.join(f"WHEN '{r}' THEN '{t}'" for r, t in _labels.items())} END AS Cluster_Label FROM labels)"""
add("label_clusters", "KMeans_Cluster:i; Role:s; Cluster_Label:s", lambda s, d: K.label_clusters(tiered(s, d)),
    "SELECT * FROM named", LABELS)
add("cluster_profile_summary", "Cluster_Label:s; " + PROFILE,
    lambda s, d: (lambda t: K.profile_labelled(K.cluster_profile(t), K.label_clusters(t)))(tiered(s, d)),
    f"SELECT * FROM ({PROFILE_SQL}) LEFT JOIN named USING (KMeans_Cluster)", LABELS)
add("customer_data_clustered", "CustomerID:i; KMeans_Cluster:i; Cluster_Label:s; Monetary:f; RFM_segment_ind:s",
    lambda s, d: (lambda t: K.with_labels(t, K.label_clusters(t)))(tiered(s, d)),
    "SELECT * FROM tiered LEFT JOIN named USING (KMeans_Cluster)", LABELS)
add("bars_cluster_value", BARS,
    lambda s, d: V.currency_bars(K.cluster_profile(tiered(s, d)), "KMeans_Cluster", "Avg_Monetary"),
    _bars_sql(PROFILE_SQL, "KMeans_Cluster", "Avg_Monetary", money_label_sql("Avg_Monetary")), TIERED)
add("bars_cluster_buyer_rate", BARS,
    lambda s, d: V.percent_bars(K.cluster_profile(tiered(s, d)), "KMeans_Cluster", "Focus_Buyer_Rate"),
    _bars_sql(PROFILE_SQL, "KMeans_Cluster", "Focus_Buyer_Rate", percent_label_sql("Focus_Buyer_Rate")), TIERED)
add("bubbles_cluster", "Cluster:i; Avg_Recency:f; Avg_Frequency:f; Customers:i; Label:s",
    lambda s, d: V.bubbles(K.cluster_profile(tiered(s, d)), "KMeans_Cluster"),
    f"SELECT KMeans_Cluster AS Cluster, Avg_Recency, Avg_Frequency, Customers, concat('C', KMeans_Cluster) AS Label FROM ({PROFILE_SQL})",
    TIERED)

# ------------------------------------------------------------------ ANOVA


def _anova_sql(v: str) -> str:
    x = f"CAST({v} AS DOUBLE)"
    return f"""SELECT '{v}' AS Variable, sum(n * (m - g) * (m - g)) AS ssb, sum((n - 1) * s) AS ssw, sum(n) - count(*) AS df2 FROM
      (SELECT count(*) AS n, avg({x}) AS m, var_samp({x}) AS s, (SELECT avg({x}) FROM tiered) AS g FROM tiered GROUP BY KMeans_Cluster)"""


ANOVA_SQL = f"""SELECT *, CASE WHEN P_Value < 0.05 THEN 'Yes' ELSE 'No' END AS Significant_5pct,
  CASE WHEN P_Value < 0.01 THEN 'Yes' ELSE 'No' END AS Significant_1pct FROM (
  SELECT Variable, F_Value, {solve.f_upper_even_sql('F_Value', 4, 'df2')} AS P_Value, Eta_Squared FROM (
  SELECT Variable, (ssb / 4) / (ssw / df2) AS F_Value, ssb / (ssb + ssw) AS Eta_Squared, df2
  FROM ({' UNION ALL '.join(_anova_sql(v) for v in presets.ANOVA_VARIABLES)})))"""
add("anova_cluster_separation_results",
    "Variable:s; F_Value:f4; P_Value:f; Eta_Squared:f; Significant_5pct:s; Significant_1pct:s",
    lambda s, d: A.anova_oneway(tiered(s, d), "KMeans_Cluster", presets.ANOVA_VARIABLES), ANOVA_SQL, TIERED)
add("anova_report_table", "Variable:s; F value:f; p-value:s; Eta squared:f; Significant at 5%:s",
    lambda s, d: A.anova_report(A.anova_oneway(tiered(s, d), "KMeans_Cluster", presets.ANOVA_VARIABLES)),
    f"""SELECT Variable, round(F_Value, 2) AS "F value", CASE WHEN P_Value < 0.001 THEN '<0.001'
    ELSE CAST(round(P_Value, 4) AS VARCHAR) END AS "p-value", round(Eta_Squared, 3) AS "Eta squared",
    Significant_5pct AS "Significant at 5%" FROM ({ANOVA_SQL})""", TIERED)

QUERIES, SQL = book.queries, book.sql
