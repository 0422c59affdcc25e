"""Upper tails of t, F and binomial distributions for result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stirling_error(n: float) -> float:
    """log Gamma(n) minus its Stirling approximation (n - 1/2) log n - n + log(2 pi) / 2."""
    if n < 30.0:
        return math.lgamma(n) - (n - 0.5) * math.log(n) + n - 0.5 * math.log(2.0 * math.pi)
    s = 1.0 / (n * n)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / n


def deviance_term(a: float, m: float) -> float:
    """a log(a / m) + m - a without loss where a is close to m."""
    if abs(a - m) < 0.1 * (a + m):
        v = (a - m) / (a + m)
        total, power, k = (a - m) * v, 2.0 * a * v, 1
        while True:
            power *= v * v
            step = power / (2 * k + 1)
            if total + step == total:
                return total
            total, k = total + step, k + 1
    return a * math.log(a / m) + m - a


def log_beta_front(a: float, b: float, x: float, y: float) -> float:
    """log of x^a y^b / B(a, b) for x + y = 1, precise for large a and b: nothing large is subtracted."""
    n = a + b
    far = deviance_term(a, n * x) + deviance_term(b, n * y)
    near = stirling_error(n) - stirling_error(a) - stirling_error(b)
    return 0.5 * math.log(a * b / (2.0 * math.pi * n)) - far + near


MAX_TERMS = 20_000_000


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function by its continued fraction in x and y; ``y`` is 1 - x where that is known more
    precisely. The terms use the distance to the mean, a y - b x, so that nothing is lost when a and b are large."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    distance = (a + b) * y - b if y <= x else a - (a + b) * x
    if distance < 0.0:
        return 1.0 - incomplete_beta(b, a, y, x)
    log_front = log_beta_front(a, b, x, y)
    if log_front < -745.0:
        return 0.0
    value = c = a * (distance + 1.0) / (a + 1.0)
    d = 0.0
    for m in range(1, MAX_TERMS):
        top = (a + m - 1.0) * (a + b + m - 1.0) * m * (b - m) * x * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m - 1.0))
        bottom = m + m * (b - m) * x / (a + 2.0 * m - 1.0) + (a + m) * (distance + 1.0 + m * (1.0 + y)) / (a + 2.0 * m + 1.0)
        d = 1.0 / (bottom + top * d)
        c = bottom + top / c
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            return math.exp(log_front) / value
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f <= 0.0:
        return 1.0
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


def binomial_upper(successes: int, trials: int, p: float) -> float:
    """P(X >= successes)."""
    if successes <= 0:
        return 1.0
    return incomplete_beta(float(successes), float(trials - successes + 1), p)


@F.pandas_udf(T.DoubleType())
def f_upper_column(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else f_upper(x, a, b) for x, a, b in zip(f, df1, df2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_upper_column(successes: pd.Series, trials: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_upper(int(k), int(n), q) for k, n, q in zip(successes, trials, p)], dtype="float64")
