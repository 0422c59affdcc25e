"""Least squares and influence. The cluster builds moments; the driver solves a p×p system."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moments import collect_moments, invert_spd
from ..functions.tails import f_upper, t_two_sided

COEFFICIENT_SCHEMA = "term string, estimate double, std_error double, statistic double, p_value double"


def add_up(terms: Sequence[Column]) -> Column:
    return reduce(Column.__add__, terms)


@dataclass(frozen=True)
class OlsFit:
    """A fitted linear model. Everything here has the size of the model, not of the data."""

    target: str
    names: list[str]
    n: int
    mean: np.ndarray           # predictor means
    slopes: np.ndarray
    intercept: float
    inverse: np.ndarray        # inverse of the centred cross-product matrix
    rss: float
    tss: float

    @property
    def rank(self) -> int:
        return len(self.names) + 1

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_residual

    @property
    def r_squared(self) -> float:
        return 1.0 - self.rss / self.tss

    def coefficient(self, name: str) -> float:
        return float(self.slopes[self.names.index(name)])

    def predicted(self) -> Column:
        terms = [F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(self.slopes, self.names)]
        return add_up([F.lit(float(self.intercept)), *terms])

    def leverage(self) -> Column:
        """Diagonal of the hat matrix as a column: 1/n + d' inverse d with d centred."""
        d = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(self.names, self.mean)]
        quadratic = [
            F.lit(float(self.inverse[i, j] * (1 if i == j else 2))) * d[i] * d[j]
            for i in range(len(d)) for j in range(i, len(d))
        ]
        return add_up([F.lit(1.0 / self.n), *quadratic])

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, statistic, p_value."""
        variance = self.sigma2 * np.diag(self.inverse)
        intercept_variance = self.sigma2 * (1.0 / self.n + self.mean @ self.inverse @ self.mean)
        rows = []
        for term, b, v in zip(["(Intercept)", *self.names], [self.intercept, *self.slopes], [intercept_variance, *variance]):
            se = float(np.sqrt(v))
            t = float(b) / se if se > 0 else float("inf")
            rows.append((term, float(b), se, t, t_two_sided(t, self.df_residual)))
        return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)

    def summary(self, spark: SparkSession) -> DataFrame:
        """n, residual standard error, R squared, adjusted R squared, F test."""
        k = len(self.names)
        f = ((self.tss - self.rss) / k) / self.sigma2 if self.sigma2 > 0 else float("inf")
        adjusted = 1 - (1 - self.r_squared) * (self.n - 1) / self.df_residual
        p = f_upper(f, k, self.df_residual)
        return spark.createDataFrame(
            [(self.n, self.df_residual, float(np.sqrt(self.sigma2)), self.r_squared, adjusted, float(f), p)],
            "n long, df_residual long, sigma double, r_squared double, adj_r_squared double, f_statistic double, p_value double",
        )


def ols_fit(df: DataFrame, target: str, predictors: Sequence[str]) -> OlsFit:
    """Least squares with intercept over the complete rows.

    Means, then sums of products beside them, are added up map-side, whatever
    the number of rows. Dependent or constant predictors raise with their names.
    """
    names = list(predictors)
    m = collect_moments(df, [*names, target])
    p = len(names)
    if m.n <= p + 1:
        raise ValueError(f"{m.n} complete rows for {p + 1} coefficients")
    cross = (m.n - 1) * m.cov
    inverse = invert_spd(cross[:p, :p], names)
    slopes = inverse @ cross[:p, p]
    tss = float(cross[p, p])
    rss = max(0.0, tss - float(slopes @ cross[:p, p]))
    return OlsFit(target, names, m.n, m.mean[:p], slopes, float(m.mean[p] - slopes @ m.mean[:p]), inverse, rss, tss)


def cooks_distance(df: DataFrame, fit: OlsFit) -> DataFrame:
    """Cook's distance per row with the 4/n and 1 flags. A narrow projection over the rows.

    Null where a predictor is missing or the leverage is one.
    """
    residual = F.col(fit.target).cast("double") - fit.predicted()
    h = fit.leverage()
    distance = F.try_divide(
        residual * residual * h, F.lit(float(fit.rank * fit.sigma2)) * (F.lit(1.0) - h) * (F.lit(1.0) - h))
    return df.withColumn("Cooks_Distance", distance).withColumns({
        "Influence_4_over_n": F.col("Cooks_Distance") > F.lit(4.0 / fit.n),
        "Influence_gt_1": F.col("Cooks_Distance") > F.lit(1.0),
    })


# The reported columns of the influence check, in order.
INFLUENCE_COLUMNS = [
    "CustomerID", "Monetary", "Frequency", "Recency", "FocusSpend", "FocusQuantity", "FocusShare",
    "Cooks_Distance", "Influence_4_over_n", "Influence_gt_1",
]


def most_influential(influence: DataFrame, n: int = 20) -> DataFrame:
    return influence.select(*INFLUENCE_COLUMNS).orderBy(F.desc("Cooks_Distance"), "CustomerID").limit(n)


def inspect_customer(influence: DataFrame, customer_id: object) -> DataFrame:
    return influence.where(F.col("CustomerID") == F.lit(customer_id)).select(*INFLUENCE_COLUMNS)
