"""Queries on discriminant targeting. Classes are the monetary tiers, prospects every fifth customer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import presets
from ..operators import charts as V
from ..operators import clustering as K
from ..operators import discriminant as D
from ..operators.levels import lda_fit_levels
from ..sources import views
from ..session import written
from . import base as B
from . import solve
from .clusters import LABELS, tiered
from .customers import BARS, _bars_sql, percent_label_sql
from .shape import Book

book = Book()
add = book.add
X = presets.DEMOGRAPHICS
P = 0.70
WORK = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DESIGN = {"Married": "Married", "HouseholdSize": "HouseholdSize", "Income": "Income", "Age": "Age",
          **{f"Work_{w}": f"CASE WHEN Work = '{w}' THEN 1.0 ELSE 0.0 END" for w in WORK[1:]}, "Education": "Education"}
NUMERIC = ["Married", "HouseholdSize", "Income", "Age", "Education"]


def members_of(t: DataFrame, names: DataFrame) -> DataFrame:
    """Current customers with class and label."""
    return D.lda_input(K.with_labels(t.where(F.col("CustomerID") % 5 != 0), names))


def members(s: SparkSession, d: str) -> DataFrame:
    t = tiered(s, d)
    return members_of(t, K.label_clusters(t))


def _split(known: DataFrame, slices: int | None = None) -> DataFrame:
    key = (F.col("CustomerID") * 2654435761) % 1000003
    return D.stratified_split(known, "KMeans_Cluster", "CustomerID", P, key, slices=slices)


def split(s: SparkSession, d: str, slices: int | None = None) -> DataFrame:
    return _split(members(s, d), slices)


class Fitted(NamedTuple):
    split: DataFrame
    labels: DataFrame
    scaler: D.Scaler
    fit: D.LdaFit


def fitted(s: SparkSession, d: str) -> Fitted:
    """The split, the labels and the model of one query: each part is made once."""
    t = tiered(s, d)
    names = written(K.label_clusters(t))
    parts = written(_split(members_of(t, names)))
    train = parts.where("is_train")
    scaler = D.fit_scaler(train, X)
    return Fitted(parts, names, scaler, D.lda_fit(scaler.apply(train), "KMeans_Cluster", X))


def test_predictions(s: SparkSession, d: str) -> DataFrame:
    f = fitted(s, d)
    return f.fit.predict(f.scaler.apply(f.split.where("not is_train")))


def level_predictions(s: SparkSession, d: str) -> DataFrame:
    """The same predictions with the levels as rows of tables."""
    parts = written(split(s, d))
    return lda_fit_levels(parts.where("is_train"), "KMeans_Cluster", X).predict(parts.where("not is_train"))


def targeted(s: SparkSession, d: str) -> DataFrame:
    f = fitted(s, d)
    return D.target_priority(D.score_prospects(views.prospects(s, d), f.fit, f.scaler, f.labels))


SPLIT = LABELS + f""",
members AS (SELECT tiered.*, Cluster_Label FROM tiered LEFT JOIN named USING (KMeans_Cluster) WHERE CustomerID % 5 <> 0),
split AS (SELECT *, row_number() OVER (PARTITION BY KMeans_Cluster ORDER BY (CustomerID * 2654435761) % 1000003, CustomerID)
          <= ceil(CAST({P} AS DOUBLE) * count(*) OVER (PARTITION BY KMeans_Cluster)) AS is_train FROM members)"""
_names = list(DESIGN)
_n = len(_names)
_design = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(DESIGN.values()))
_pool = ", ".join(f"sum((n - 1) * a_{i}_{j}) / (sum(n) - count(*)) AS a_{i}_{j}" for i in range(_n) for j in range(_n))
_means = ", ".join(f"m_{i}, m_{i} AS b_{i}_0" for i in range(_n))
_delta = " + ".join(f"b_{i}_0 * (x{i} - m_{i} / 2)" for i in range(_n))
MODEL = SPLIT + f""",
train AS (SELECT KMeans_Cluster, {_design} FROM split WHERE is_train),
{solve.moments_cte('per_class', 'train', [f'x{i}' for i in range(_n)], ['KMeans_Cluster']).replace('AS (', 'AS MATERIALIZED (', 1)},
pooled AS MATERIALIZED (SELECT {_pool} FROM per_class),
system AS (SELECT KMeans_Cluster AS cls, n::DOUBLE / (SELECT sum(n) FROM per_class) AS prior, {_means}, pooled.* FROM per_class CROSS JOIN pooled),
{solve.eliminate('weights', 'system', _n, ['b@_0'], ['cls', 'prior', *[f'm_{i}' for i in range(_n)]])}"""


def scored_sql(name: str, source: str) -> str:
    posterior = ", ".join(f"max(w) FILTER (WHERE cls = {c}) / sum(w) AS Cluster_Probability_{c}" for c in range(1, 6))
    return f"""{name}_d AS (SELECT CustomerID, cls, {_delta} + ln(prior) AS delta FROM (SELECT *, {_design} FROM {source}) CROSS JOIN weights),
{name}_w AS (SELECT *, exp(delta - max(delta) OVER (PARTITION BY CustomerID)) AS w FROM {name}_d),
{name}_p AS (SELECT CustomerID, arg_max(cls, w) AS Predicted_Cluster, max(w) / sum(w) AS Max_Cluster_Probability, {posterior}
  FROM {name}_w GROUP BY CustomerID),
{name} AS (SELECT * FROM {source} JOIN {name}_p USING (CustomerID))"""


TESTED = MODEL + ",\n" + scored_sql("tested", "(SELECT * FROM split WHERE NOT is_train)")
_confusion = """, cells AS (SELECT p.c AS Predicted_Cluster, a.c AS Actual_Cluster, count(t.CustomerID) AS Customers
  FROM range(1, 6) AS p(c) CROSS JOIN range(1, 6) AS a(c)
  LEFT JOIN tested t ON t.Predicted_Cluster = p.c AND t.KMeans_Cluster = a.c GROUP BY ALL)"""
CELLS = TESTED + _confusion
_priority = presets.cluster_labels()
TARGETED = MODEL + ",\n" + scored_sql("scored_prospects", "(SELECT * FROM people0 WHERE CustomerID % 5 = 0)") + f""",
targeted AS (SELECT s.*, Cluster_Label AS Predicted_Cluster_Label, CASE Cluster_Label
  WHEN '{_priority["loyal"]}' THEN 'Primary target' WHEN '{_priority["committed"]}' THEN 'Secondary target'
  ELSE 'Lower priority' END AS Target_Priority FROM scored_prospects s LEFT JOIN named ON KMeans_Cluster = Predicted_Cluster)"""

PROBABILITIES = "; ".join(f"Cluster_Probability_{c}:f" for c in range(1, 6)) + "; Max_Cluster_Probability:f"

add("lda_input_check", "Customers:i; Missing_Values:i; Clusters:i",
    lambda s, d: D.input_check(members(s, d), "Customers", "KMeans_Cluster"),
    "SELECT count(*) AS Customers, " + " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in X)
    + " AS Missing_Values, count(DISTINCT KMeans_Cluster) AS Clusters FROM members", SPLIT)
add("lda_class_counts", "KMeans_Cluster:i; Cluster_Label:s; n:i",
    lambda s, d: members(s, d).groupBy("KMeans_Cluster", "Cluster_Label").agg(F.count(F.lit(1)).alias("n")),
    "SELECT KMeans_Cluster, Cluster_Label, count(*) AS n FROM members GROUP BY ALL", SPLIT)
add("prospect_input_check", "Prospects:i; Missing_Values:i",
    lambda s, d: D.input_check(views.prospects(s, d).select("CustomerID", *X), "Prospects"),
    "SELECT count(*) AS Prospects, " + " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in X)
    + " AS Missing_Values FROM people0 WHERE CustomerID % 5 = 0", B.RETAIL)
add("stratified_split", "CustomerID:i; KMeans_Cluster:i; is_train:b", split, "SELECT * FROM split", SPLIT)
add("stratified_split_by_cut_points", "CustomerID:i; KMeans_Cluster:i; is_train:b",
    lambda s, d: split(s, d, 7), "SELECT * FROM split", SPLIT)
for _part, _test in (("train", "is_train"), ("test", "NOT is_train")):
    add(f"lda_class_shares_{_part}", "KMeans_Cluster:i; n:i; Share:f",
        lambda s, d, t=_test: D.class_shares(split(s, d).where(t)),
        f"""SELECT KMeans_Cluster, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM split WHERE {_test}) AS Share
        FROM split WHERE {_test} GROUP BY 1""", SPLIT)
add("lda_scaled_train", "CustomerID:i; " + "; ".join(f"{x}:f" for x in NUMERIC),
    lambda s, d: (lambda f: f.scaler.apply(f.split.where("is_train")))(fitted(s, d)),
    "SELECT CustomerID, " + ", ".join(
        f"({x} - (SELECT avg({x}) FROM split WHERE is_train)) / (SELECT stddev_samp({x}) FROM split WHERE is_train) AS {x}"
        for x in NUMERIC) + " FROM split WHERE is_train", SPLIT)
add("lda_priors", "Cluster:s; n:i; Prior:f", lambda s, d: fitted(s, d).fit.prior_table(s),
    """SELECT KMeans_Cluster AS Cluster, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM split WHERE is_train) AS Prior
    FROM split WHERE is_train GROUP BY 1""", SPLIT)


def _unscaled_fit(s: SparkSession, d: str) -> D.LdaFit:
    return D.lda_fit(written(split(s, d)).where("is_train"), "KMeans_Cluster", X)


add("lda_group_means", "Cluster:s; Variable:s; Mean:f", lambda s, d: _unscaled_fit(s, d).mean_table(s),
    " UNION ALL ".join(
        f"SELECT KMeans_Cluster AS Cluster, '{v}' AS Variable, avg(x{i}) AS Mean FROM train GROUP BY 1"
        for i, v in enumerate(_names)), SPLIT + f", train AS (SELECT KMeans_Cluster, {_design} FROM split WHERE is_train)")
_inverse = solve.eliminate("inverse", "(SELECT *, " + solve.identity_columns(_n) + " FROM pooled)", _n, solve.identity_rhs(_n), []).replace("inverse AS (", "inverse AS MATERIALIZED (")
_long = lambda prefix, sep, src: " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, {prefix}_{i}{sep}{j} AS v FROM {src}" for i in range(_n) for j in range(_n))
_gap = lambda i: f"(m_{i} - (SELECT sum(n * m_{i}) / sum(n) FROM per_class))"
DISCRIMINANTS = MODEL + f""",
{_inverse},
metric AS MATERIALIZED ({_long('a', '_', 'pooled')}),
between_classes AS MATERIALIZED (SELECT {', '.join(f'sum(n * {_gap(i)} * {_gap(j)}) / (count(*) - 1) AS h_{i}_{j}' for i in range(_n) for j in range(_n))} FROM per_class),
spread AS MATERIALIZED ({_long('h', '_', 'between_classes')}),
inverse_long AS MATERIALIZED ({_long('e', '__', 'inverse')}),
target AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM inverse_long a JOIN spread b ON a.j = b.i GROUP BY 1, 2),
{solve.principal_components('lds', 'target', 4, metric='metric')}"""
_variables = "(SELECT i, v AS Variable FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_names)) + ") AS t(i, v))"
add("lda_discriminants", "Variable:s; Discriminant:s; Coefficient:f",
    lambda s, d: _unscaled_fit(s, d).discriminant_table(s),
    f"SELECT Variable, concat('LD', pc) AS Discriminant, loading AS Coefficient FROM lds JOIN {_variables} USING (i)", DISCRIMINANTS)
add("lda_proportion_of_trace", "Discriminant:s; Eigenvalue:f; Trace_Share:f", lambda s, d: fitted(s, d).fit.trace_table(s),
    """SELECT concat('LD', pc) AS Discriminant, e AS Eigenvalue, e / sum(e) OVER () AS Trace_Share FROM
    (SELECT pc, max(eigenvalue) AS e FROM lds GROUP BY 1)""", DISCRIMINANTS)
add("lda_test_predictions", "CustomerID:i; KMeans_Cluster:i; Predicted_Cluster:i; " + PROBABILITIES, test_predictions,
    "SELECT * FROM tested", TESTED)
add("lda_test_predictions_by_levels", "CustomerID:i; KMeans_Cluster:i; Predicted_Cluster:i; " + PROBABILITIES, level_predictions,
    "SELECT * FROM tested", TESTED)
add("lda_confusion_matrix", "Predicted_Cluster:i; Actual_Cluster:i; Customers:i",
    lambda s, d: D.confusion_matrix(test_predictions(s, d), range(1, 6)), "SELECT * FROM cells", CELLS)
add("lda_overall_metrics", "Accuracy:f; Kappa:f; No_Information_Rate:f; Accuracy_P_Value:f",
    lambda s, d: D.overall_metrics(D.confusion_matrix(test_predictions(s, d), range(1, 6))),
    """SELECT hits / n AS Accuracy, (hits / n - e) / (1 - e) AS Kappa, q AS No_Information_Rate,
       (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(q) + (n - k) * ln(1 - q)))
        FROM range(0, 100000) AS r(k) WHERE k >= hits AND k <= n) AS Accuracy_P_Value
       FROM (SELECT n, hits, largest / n AS q, chance / (n * n) AS e FROM totals)""",
    CELLS + """, totals AS (SELECT (SELECT sum(Customers)::DOUBLE FROM cells) AS n,
       (SELECT sum(Customers)::DOUBLE FROM cells WHERE Predicted_Cluster = Actual_Cluster) AS hits,
       (SELECT max(a) FROM (SELECT sum(Customers)::DOUBLE AS a FROM cells GROUP BY Actual_Cluster)) AS largest,
       (SELECT sum(p.v * a.v) FROM (SELECT Predicted_Cluster AS c, sum(Customers)::DOUBLE AS v FROM cells GROUP BY 1) p
        JOIN (SELECT Actual_Cluster AS c, sum(Customers)::DOUBLE AS v FROM cells GROUP BY 1) a USING (c)) AS chance)""")
add("lda_class_metrics",
    "Cluster:i; Sensitivity:f; Specificity:f; Pos Pred Value:f; Neg Pred Value:f; Balanced Accuracy:f",
    lambda s, d: D.class_metrics(D.confusion_matrix(test_predictions(s, d), range(1, 6))),
    """SELECT c AS Cluster, round(tp / nullif(a, 0), 3) AS Sensitivity, round((n - p - a + tp) / nullif(n - a, 0), 3) AS Specificity,
       round(tp / nullif(p, 0), 3) AS "Pos Pred Value", round((n - p - a + tp) / nullif(n - p, 0), 3) AS "Neg Pred Value",
       round((tp / nullif(a, 0) + (n - p - a + tp) / nullif(n - a, 0)) / 2, 3) AS "Balanced Accuracy" FROM (
       SELECT c, sum(Customers) FILTER (WHERE Predicted_Cluster = c)::DOUBLE AS p, sum(Customers) FILTER (WHERE Actual_Cluster = c)::DOUBLE AS a,
       sum(Customers) FILTER (WHERE Predicted_Cluster = c AND Actual_Cluster = c)::DOUBLE AS tp, sum(Customers)::DOUBLE AS n
       FROM range(1, 6) AS r(c) CROSS JOIN cells GROUP BY c)""", CELLS)
_raw = "Married:i; HouseholdSize:i; Income:f; Age:i; ZipCode:s; Work:s; Education:i"
add("prospect_targeting_lda_predictions",
    f"CustomerID:i; Predicted_Cluster:i; Predicted_Cluster_Label:s; {PROBABILITIES}; {_raw}; Target_Priority:s", targeted,
    "SELECT * FROM targeted", TARGETED)
add("prospect_attributes_rejoined", f"CustomerID:i; Predicted_Cluster:i; Max_Cluster_Probability:f; {_raw}",
    lambda s, d: D.rejoin_attributes(
        targeted(s, d).select("CustomerID", "Predicted_Cluster", "Max_Cluster_Probability"), views.prospects(s, d),
        ["Married", "HouseholdSize", "Income", "Age", "ZipCode", "Work", "Education"]),
    "SELECT * FROM targeted", TARGETED)


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS Prospects, count(*)::DOUBLE / (SELECT count(*) FROM targeted) AS Prospect_Share,
      avg(Max_Cluster_Probability) AS Avg_Max_Probability, median(Income) AS Median_Income, median(Age) AS Median_Age,
      median(HouseholdSize) AS Median_HouseholdSize FROM targeted GROUP BY ALL"""


_measures = "Prospects:i; Prospect_Share:f; Avg_Max_Probability:f; Median_Income:f; Median_Age:f; Median_HouseholdSize:f"
_by_cluster = _summary_sql("Predicted_Cluster, Predicted_Cluster_Label")
add("prospect_cluster_summary", f"Predicted_Cluster:i; Predicted_Cluster_Label:s; {_measures}",
    lambda s, d: D.prospect_cluster_summary(written(targeted(s, d))), _by_cluster, TARGETED)
add("prospect_cluster_report",
    "Predicted cluster:i; Cluster label:s; Prospects:i; Share:s; Avg prediction probability:s; Median income (£000s):f; "
    "Median age:f; Median household size:f",
    lambda s, d: D.prospect_report(D.prospect_cluster_summary(written(targeted(s, d)))),
    f"""SELECT Predicted_Cluster AS "Predicted cluster", Predicted_Cluster_Label AS "Cluster label", Prospects,
    {percent_label_sql('Prospect_Share')} AS Share, {percent_label_sql('Avg_Max_Probability')} AS "Avg prediction probability",
    Median_Income AS "Median income (£000s)", Median_Age AS "Median age", Median_HouseholdSize AS "Median household size"
    FROM ({_by_cluster})""", TARGETED)
add("prospect_priority_summary", f"Target_Priority:s; {_measures}",
    lambda s, d: D.priority_summary(written(targeted(s, d))), _summary_sql("Target_Priority"), TARGETED)
_top = ("CustomerID:i; Target_Priority:s; Predicted_Cluster:i; Predicted_Cluster_Label:s; Max_Cluster_Probability:f; Income:f; "
        "Age:i; HouseholdSize:i; Married:i; Work:s; Education:i")
add("top_prospect_targets", _top, lambda s, d: D.top_targets(targeted(s, d)),
    "SELECT * FROM targeted WHERE Target_Priority <> 'Lower priority'", TARGETED)
add("top_prospect_targets_head", _top, lambda s, d: D.top_targets(targeted(s, d), 30),
    """SELECT * FROM targeted WHERE Target_Priority <> 'Lower priority'
    ORDER BY Target_Priority, Max_Cluster_Probability DESC, CustomerID LIMIT 30""", TARGETED)
add("bars_prospect_priority", BARS,
    lambda s, d: V.count_share_bars(D.priority_summary(written(targeted(s, d))), "Target_Priority", "Prospects", "Prospect_Share"),
    _bars_sql(_summary_sql("Target_Priority"), "Target_Priority", "Prospects",
              f"concat(Prospects, ' (', {percent_label_sql('Prospect_Share')}, ')')"), TARGETED)

QUERIES, SQL = book.queries, book.sql
