"""Queries on the influence model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.presets import INFLUENCE_PREDICTORS as X
from ..operators import features as C
from ..operators import regression as G
from ..session import settled
from . import base as B
from . import solve
from .shape import Book

book = Book()
add = book.add


def _initial(spark: SparkSession, sf: str) -> DataFrame:
    return settled(spark, lambda: C.customer_features_initial(B.lines(spark, sf), B.focus()))


def _influence(spark: SparkSession, sf: str) -> DataFrame:
    df = _initial(spark, sf)
    return G.cooks_distance(df, G.ols_fit(df, "LogMonetary", X))


_p = len(X)
SOURCE = B.PEOPLE + ",\ninitial AS (SELECT * REPLACE (" + ", ".join(
    f"CAST({x} AS DOUBLE) AS {x}" for x in X) + "), ln(CAST(Monetary AS DOUBLE)) AS LogMonetary FROM people)"
MODEL = SOURCE + ",\n" + solve.ols_ctes("model", "initial", X, "LogMonetary")
_quadratic = " + ".join(f"(x.{X[i]} - m_{i}) * e_{i}__{j} * (x.{X[j]} - m_{j})" for i in range(_p) for j in range(_p))
_fitted = " + ".join(["intercept", *[f"b_{i}_0 * x.{X[i]}" for i in range(_p)]])
COOK = MODEL + f""",
leverage AS (SELECT x.*, n, sigma2, LogMonetary - ({_fitted}) AS e, 1.0 / n + ({_quadratic}) / (n - 1) AS h
             FROM initial AS x CROSS JOIN model),
influence AS (SELECT *, e * e * h / ({_p + 1} * sigma2 * (1 - h) * (1 - h)) AS Cooks_Distance FROM leverage),
flagged AS (SELECT *, Cooks_Distance > 4.0 / n AS Influence_4_over_n, Cooks_Distance > 1 AS Influence_gt_1 FROM influence)"""

TIDY = "term:s; estimate:f9; std_error:f9; statistic:f6; p_value:f6"
FLAGGED = ("CustomerID:i; Monetary:f; Frequency:i; Recency:i; FocusSpend:f; FocusQuantity:i; FocusShare:f; Cooks_Distance:f9; "
           "Influence_4_over_n:b; Influence_gt_1:b")

add("influence_model", TIDY, lambda s, d: G.ols_fit(_initial(s, d), "LogMonetary", X).coefficients(s),
    solve.coefficient_rows("model", X), MODEL)
_f = f"((((n - 1) * yy_0 - rss) / {_p}) / sigma2)"
add("influence_model_summary",
    "n:i; df_residual:i; sigma:f; r_squared:f; adj_r_squared:f; f_statistic:f4; p_value:f6",
    lambda s, d: G.ols_fit(_initial(s, d), "LogMonetary", X).summary(s),
    f"""SELECT n, n - {_p + 1} AS df_residual, sqrt(sigma2) AS sigma, 1 - rss / ((n - 1) * yy_0) AS r_squared,
    1 - (rss / ((n - 1) * yy_0)) * (n - 1) / (n - {_p + 1}) AS adj_r_squared, {_f} AS f_statistic,
    {solve.f_upper_even_sql(_f, _p, f'n - {_p + 1}')} AS p_value FROM model""", MODEL)
add("cooks_distance", FLAGGED, _influence, "SELECT * FROM flagged", COOK)
add("most_influential", FLAGGED, lambda s, d: G.most_influential(_influence(s, d), 20),
    "SELECT * FROM flagged ORDER BY Cooks_Distance DESC, CustomerID LIMIT 20", COOK)
add("inspect_customer", FLAGGED, lambda s, d: G.inspect_customer(_influence(s, d), 7),
    "SELECT * FROM flagged WHERE CustomerID = 7", COOK)

QUERIES, SQL = book.queries, book.sql
