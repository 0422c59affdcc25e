"""Column expressions shared by the jobs. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; null where the denominator is zero (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def quotient_with_infinity(numerator: Column, denominator: Column) -> Column:
    """Double quotient that keeps x/0 as a signed infinity and 0/0 as null."""
    x, d = numerator.cast("double"), denominator.cast("double")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(x, d))


def mean_of(column: Column) -> Column:
    """Mean as exact sum over count, so decimals give one value in every summation order."""
    return ratio(F.sum(column), F.count(column))


def percent_label(share: Column, digits: int = 1) -> Column:
    """0.394 -> '39.4%'."""
    return F.format_string(f"%.{digits}f%%", share.cast("double") * 100)


def currency_label(amount: Column, digits: int = 0, prefix: str = "£") -> Column:
    """1234.5 -> '£1,234.50'; the sign goes before the prefix."""
    x = amount.cast("double")
    text = F.concat(F.lit(prefix), F.format_number(F.abs(x), digits))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def count_label(n: Column, share: Column) -> Column:
    """Two-line bar label: count, then share in brackets."""
    return F.concat(n.cast("string"), F.lit("\n("), percent_label(share), F.lit(")"))


def is_missing(name: str, dtype: str) -> Column:
    """Null, or NaN in a floating column."""
    column = F.col(f"`{name}`")
    if dtype in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def safe_log(column: Column) -> Column:
    """Natural log; null (not an error, not -Infinity) for values that have none."""
    x = column.cast("double")
    return F.when(x > 0, F.ln(x))


def leading_word(column: Column, pattern: str = "^[A-Za-z]+") -> Column:
    """First regex match, null when there is none."""
    return F.nullif(F.regexp_extract(column, pattern, 0), F.lit(""))


def first_matching_label(column: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first case-insensitive pattern that matches."""
    if not rules:
        return F.lit(default)
    chain = None
    for pattern, label in rules:
        test = column.rlike(f"(?i){pattern}")
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(default))


def total_of(column: str) -> Column:
    """Sum of a column over all rows of a result with one row per group of a fixed list."""
    return F.sum(column).over(W.partitionBy())
