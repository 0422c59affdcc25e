"""Conjoint analysis: design checks, part-worths, willingness to pay, importance, choice shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import presets
from ..functions.moments import as_doubles, group_moments, pairs
from ..functions.scalars import currency_label, mean_of, percent_label, quotient_with_infinity, ratio
from ..session import written
from .common import join_on_keys
from .outliers import trim_percentile
from .rank import summarise
from .regression import OlsFit, add_up, ols_fit

PRICE = "Price"
# a column whose variance falls below this share of its own after removing the earlier ones is aliased
ALIAS_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Survey:
    """Column names and ordered levels of a rated-profile study. The first level is the base."""

    levels: Mapping[str, Sequence[str]] = field(default_factory=lambda: presets.SURVEY_LEVELS)
    price: str = "price"
    rating: str = "rating"
    respondent: str = "respondent_id"
    profile: str = "productNo"

    def attribute_name(self, attribute: str) -> str:
        return attribute.capitalize()

    def dummies(self) -> dict[str, Column]:
        """0/1 column per non-base level; null for a level that is not listed."""
        out = {}
        for attribute, levels in self.levels.items():
            known = F.col(attribute).isin(list(levels))
            for level in levels[1:]:
                out[f"{attribute}{level}"] = F.when(known, (F.col(attribute) == level).cast("double"))
        return out

    @property
    def terms(self) -> list[str]:
        return [self.price, *[f"{a}{v}" for a, levels in self.levels.items() for v in levels[1:]]]

    def level_slots(self) -> list[tuple[str, str, int | None]]:
        """(Attribute, Level, position among the terms); base levels have no term."""
        slots: list[tuple[str, str, int | None]] = [(PRICE, PRICE, 0)]
        position = 1
        for attribute, levels in self.levels.items():
            slots.append((self.attribute_name(attribute), levels[0], None))
            for level in levels[1:]:
                slots.append((self.attribute_name(attribute), level, position))
                position += 1
        return slots


# --------------------------------------------------------------------------- design


def design_levels(profiles: DataFrame, survey: Survey) -> DataFrame:
    """Levels of every attribute that the profiles show, price included."""
    return level_balance(profiles, survey).where("Level is not null").groupBy("Attribute").agg(F.count(F.lit(1)).alias("Levels"))


def design_efficiency(profiles: DataFrame, levels: DataFrame) -> DataFrame:
    """Full factorial size against the profiles shown."""
    full = levels.agg(F.round(F.product("Levels")).cast("bigint").alias("Full_Factorial_Profiles"))
    shown = profiles.agg(F.count(F.lit(1)).alias("Selected_Profiles"))
    return full.crossJoin(shown).select(
        "Full_Factorial_Profiles", "Selected_Profiles",
        (F.col("Full_Factorial_Profiles") - F.col("Selected_Profiles")).alias("Profiles_Not_Shown"),
        (F.lit(1.0) - ratio(F.col("Selected_Profiles"), F.col("Full_Factorial_Profiles"))).alias("Reduction_Percent"),
    )


def level_text(column: Column, dtype: str) -> Column:
    """Level as text; whole numbers without a decimal part."""
    if dtype in ("double", "float"):
        whole = column == F.floor(column)
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def level_balance(profiles: DataFrame, survey: Survey) -> DataFrame:
    """Profiles per level of every attribute, price included, in one scan."""
    types = dict(profiles.dtypes)
    attributes = [survey.price, *survey.levels]
    cells = [F.struct(F.lit(survey.attribute_name(a)).alias("Attribute"), level_text(F.col(a), types[a]).alias("Level"))
             for a in attributes]
    long = profiles.select(F.inline(F.array(*cells)))
    return long.groupBy("Attribute", "Level").agg(F.count(F.lit(1)).alias("n")).orderBy("Attribute", "Level")


def _design_columns(survey: Survey, sorted_base: bool) -> dict[str, Column]:
    out = {survey.price: F.col(survey.price).cast("double")}
    for attribute, levels in survey.levels.items():
        ordered = sorted(levels) if sorted_base else list(levels)
        for level in ordered[1:]:
            out[f"{attribute}{level}"] = (F.col(attribute) == level).cast("double")
    return out


def design_correlation(profiles: DataFrame, survey: Survey, sorted_base: bool = True) -> DataFrame:
    """Correlation of the design columns in long form (``sorted_base``: alphabetical base levels)."""
    columns = _design_columns(survey, sorted_base)
    names = list(columns)
    flat = profiles.select(*[c.alias(f"d{i}") for i, c in enumerate(columns.values())])
    vectors = VectorAssembler(inputCols=flat.columns, outputCol="d", handleInvalid="error").transform(flat)
    matrix = Correlation.corr(vectors, "d").first()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return profiles.sparkSession.createDataFrame(rows, "Row string, Column string, Correlation double")


def max_design_correlation(correlation: DataFrame) -> DataFrame:
    return correlation.where(F.col("Row") != F.col("Column")).agg(
        F.max(F.abs("Correlation")).alias("Max_Abs_Correlation"))


def design_quality(efficiency: DataFrame, correlation: DataFrame) -> DataFrame:
    return efficiency.crossJoin(max_design_correlation(correlation)).select(
        F.col("Selected_Profiles").alias("Profiles_Selected"), "Full_Factorial_Profiles",
        percent_label(F.col("Reduction_Percent")).alias("Reduction_Percent"),
        F.round("Max_Abs_Correlation", 3).alias("Maximum_Absolute_Correlation"))


# --------------------------------------------------------------------------- ratings


def prepare_ratings(raw: DataFrame, survey: Survey) -> DataFrame:
    """Typed ratings; a level that is not listed becomes null."""
    casts = {
        survey.respondent: F.col(survey.respondent).cast("string"),
        survey.profile: F.col(survey.profile).cast("int"),
        survey.price: F.col(survey.price).cast("double"),
        survey.rating: F.col(survey.rating).cast("double"),
    }
    levels = {a: F.when(F.col(a).isin(list(v)), F.col(a)) for a, v in survey.levels.items()}
    return raw.withColumns({**casts, **levels})


def ratings_check(ratings: DataFrame, survey: Survey) -> DataFrame:
    missing = add_up([F.col(c).isNull().cast("int") for c in ratings.columns])
    rating = F.col(survey.rating)
    return ratings.agg(
        F.count_distinct(survey.respondent).alias("Respondents"),
        F.count_distinct(survey.profile).alias("Profiles"),
        F.count(F.lit(1)).alias("Rows"),
        F.min(rating).alias("Min_Rating"),
        F.max(rating).alias("Max_Rating"),
        mean_of(rating).alias("Mean_Rating"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("Missing_Values"),
    )


def profile_rating_summary(ratings: DataFrame, survey: Survey) -> DataFrame:
    """Mean, median, deviation and number of ratings per profile, best first."""
    keys = [survey.profile, survey.price, *survey.levels]
    rating = F.col(survey.rating)
    return summarise(
        ratings,
        [mean_of(rating).alias("Avg_Rating"), F.stddev_samp(rating).alias("SD_Rating"), F.count(rating).alias("Responses")],
        {"Median_Rating": survey.rating}, by=keys,
    ).orderBy(F.desc("Avg_Rating"), *keys)


# --------------------------------------------------------------------------- pooled model


def complete_terms(ratings: DataFrame, survey: Survey, *keep: str) -> DataFrame:
    """``keep``, terms and rating of the complete ratings, as doubles.

    The rows that least squares uses. Levels are looked up once a row, so that a dummy is one comparison.
    """
    known = [F.col(a).isin(list(levels)) for a, levels in survey.levels.items()]
    rows = as_doubles(ratings, [survey.price, survey.rating], keep=[*keep, *survey.levels]).where(reduce(Column.__and__, known))
    dummies = {
        f"{a}{v}": F.when(F.col(a) == v, 1.0).otherwise(0.0) for a, levels in survey.levels.items() for v in levels[1:]}
    return rows.withColumns(dummies).select(*keep, *[f"`{n}`" for n in (*survey.terms, survey.rating)])


def pooled_fit(ratings: DataFrame, survey: Survey) -> OlsFit:
    """Rating on price and level dummies over all respondents."""
    return ols_fit(complete_terms(ratings, survey), survey.rating, survey.terms)


def part_worths(spark: SparkSession, fit: OlsFit, survey: Survey) -> DataFrame:
    """Utilities centred within each attribute (base level 0 included); price stays a slope."""
    utility = {name: float(b) for name, b in zip(fit.names, fit.slopes)}
    rows = [(a, level, 0.0 if i is None else utility[survey.terms[i]]) for a, level, i in survey.level_slots()]
    raw = spark.createDataFrame(rows, "Attribute string, Level string, Utility double")
    centred = F.col("Utility") - F.avg("Utility").over(W.partitionBy("Attribute"))
    return raw.withColumn("Part_Worth", F.when(F.col("Attribute") == PRICE, F.col("Utility")).otherwise(centred))


# --------------------------------------------------------------------------- respondent models


def _solver(survey: Survey):
    """A vectorised solver of many small normal equations, one respondent per row."""
    groups, position = [], 1
    for levels in survey.levels.values():
        groups.append(list(range(position, position + len(levels) - 1)))
        position += len(levels) - 1
    p = position
    index = pairs(p + 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(covariance: pd.Series, mean: pd.Series) -> pd.Series:
        a = np.zeros((len(covariance), p + 1, p + 1))
        flat = np.array([np.nan_to_num(np.array(x, dtype=float)) for x in covariance]).reshape(len(a), -1)
        for k, (i, j) in enumerate(index):
            a[:, i, j] = a[:, j, i] = flat[:, k]
        means = np.array([np.array(x, dtype=float) for x in mean]).reshape(len(a), -1)
        own = a[:, range(p), range(p)].copy()
        seen = means[:, :p] > 0
        absent = np.zeros((len(a), p), dtype=bool)
        for members in groups:
            # unseen levels drop out; without the base level the first seen one takes its place
            absent[:, members] = ~seen[:, members]
            no_base = means[:, members].sum(axis=1) > 1 - 1e-12
            first = np.argmax(seen[:, members], axis=1)
            absent[np.flatnonzero(no_base), np.array(members)[first[no_base]]] = True
        slopes = np.where(absent, 0.0, np.nan)
        swept = np.zeros((len(a), p), dtype=bool)
        for k in range(p):
            use = ~absent[:, k] & (a[:, k, k] > ALIAS_TOLERANCE * own[:, k]) & (own[:, k] > 0)
            rows = np.flatnonzero(use)
            swept[rows, k] = True
            b = a[rows]
            pivot = b[:, k, k][:, None]
            row = b[:, k, :] / pivot
            column = b[:, :, k].copy()
            b = b - column[:, :, None] * row[:, None, :]
            b[:, k, :] = row
            b[:, :, k] = -column / pivot
            b[:, k, k] = 1.0 / pivot[:, 0]
            a[rows] = b
        slopes = np.where(swept, a[:, :p, p], slopes)
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in slopes])

    return solve


def respondent_coefficients(ratings: DataFrame, survey: Survey) -> DataFrame:
    """One least-squares fit per respondent: ``respondent, coefficients`` (price first, then dummies).

    What is grouped is means, then sums of products per respondent, combined map-side, so a
    respondent with a third of all ratings costs no more than any other. Levels that a
    respondent never saw get 0, terms that their profiles cannot separate get null.
    """
    names = [*survey.terms, survey.rating]
    safe = [f"x{i}" for i in range(len(names))]
    columns = complete_terms(ratings, survey, survey.respondent).toDF(survey.respondent, *safe)
    place, dummies = 1, []  # x0 is the price; the level dummies of an attribute exclude each other
    for levels in survey.levels.values():
        dummies.append(safe[place : place + len(levels) - 1])
        place += len(levels) - 1
    rows = written(columns)
    sums = group_moments(rows, survey.respondent, safe, indicators=dummies)
    return sums.select(survey.respondent, _solver(survey)("cov", "mean").alias("coefficients"))


def _attribute_rows(survey: Survey) -> Column:
    """Array of (Attribute, Level, Utility, Part_Worth, price slope) from a coefficient array."""
    coefficient = lambda i: F.lit(0.0) if i is None else F.get("coefficients", F.lit(i))
    slots = survey.level_slots()
    rows = []
    for attribute, level, i in slots:
        utility = coefficient(i)
        if attribute == PRICE:
            worth = utility
        else:
            family = [coefficient(k) for a, _, k in slots if a == attribute]
            worth = utility - add_up(family) / len(family)
        rows.append(F.struct(
            F.lit(attribute).alias("Attribute"), F.lit(level).alias("Level"), utility.alias("Utility"),
            worth.alias("Part_Worth"), coefficient(0).alias("Price_Coefficient")))
    return F.array(*rows)


def respondent_part_worths(coefficients: DataFrame, survey: Survey) -> DataFrame:
    """Long part-worths, one row per respondent and level; centring needs no further shuffle."""
    return coefficients.select(survey.respondent, F.inline(_attribute_rows(survey))).drop("Price_Coefficient")


def respondent_check(worths: DataFrame, survey: Survey) -> DataFrame:
    return worths.agg(
        F.count_distinct(survey.respondent).alias("Respondents"), F.count(F.lit(1)).alias("Rows"),
        F.count_distinct("Attribute").alias("Attributes"), F.count_distinct("Level").alias("Levels"))


def part_worth_summary(worths: DataFrame) -> DataFrame:
    """Mean, median, deviation, min and max over respondents per level."""
    w = F.col("Part_Worth")
    return summarise(
        worths,
        [F.avg(w).alias("Mean_Part_Worth"), F.stddev_samp(w).alias("SD_Part_Worth"),
         F.min(w).alias("Min_Part_Worth"), F.max(w).alias("Max_Part_Worth")],
        {"Median_Part_Worth": "Part_Worth"}, by=["Attribute", "Level"],
    ).orderBy("Attribute", F.desc("Mean_Part_Worth"), "Level")


def part_worth_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        "Attribute", "Level", F.round("Mean_Part_Worth", 3).alias("Mean part-worth"),
        F.round("Median_Part_Worth", 3).alias("Median part-worth"), F.round("SD_Part_Worth", 3).alias("SD"))


# --------------------------------------------------------------------------- willingness to pay


def average_wtp(worths: DataFrame, baseline: str = "mean") -> DataFrame:
    """Part-worth over the absolute price slope. ``baseline='reference'`` measures from the base level."""
    slope = worths.where(F.col("Attribute") == PRICE).select(F.abs("Part_Worth").alias("__slope"))
    value = F.col("Part_Worth") if baseline == "mean" else F.col("Utility")
    return (
        worths.where(F.col("Attribute") != PRICE)
        .crossJoin(F.broadcast(slope))
        .withColumn("WTP", quotient_with_infinity(value, F.col("__slope")))
        .drop("__slope")
        .orderBy("Attribute", F.desc("WTP"), "Level")
    )


def respondent_wtp(coefficients: DataFrame, survey: Survey) -> DataFrame:
    """Willingness to pay by each respondent's own price slope; the slope sits in the same row."""
    long = coefficients.select(survey.respondent, F.inline(_attribute_rows(survey))).where(F.col("Attribute") != PRICE)
    return long.withColumn("WTP", quotient_with_infinity(F.col("Part_Worth"), F.abs("Price_Coefficient")))


def respondent_wtp_joined(worths: DataFrame, survey: Survey) -> DataFrame:
    """The same from a stored long table: the price rows joined back by respondent."""
    price = worths.where(F.col("Attribute") == PRICE).select(survey.respondent, F.col("Part_Worth").alias("Price_Coefficient"))
    rest = worths.where(F.col("Attribute") != PRICE).join(price, survey.respondent, "left")
    return rest.withColumn("WTP", quotient_with_infinity(F.col("Part_Worth"), F.abs("Price_Coefficient")))


def trimmed_wtp(wtp: DataFrame) -> DataFrame:
    """Willingness to pay between the overall 1st and 99th percentile."""
    return trim_percentile(wtp, "WTP", 0.01, 0.99)


def wtp_summary(clean: DataFrame) -> DataFrame:
    w = F.col("WTP")
    return summarise(
        clean, [F.avg(w).alias("Mean_WTP"), F.stddev_samp(w).alias("SD_WTP")], {"Median_WTP": "WTP"},
        by=["Attribute", "Level"],
    ).orderBy("Attribute", F.desc("Mean_WTP"), "Level")


def wtp_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        "Attribute", "Level", currency_label(F.col("Mean_WTP"), 2).alias("Mean WTP (£)"),
        currency_label(F.col("Median_WTP"), 2).alias("Median WTP (£)"), F.round("SD_WTP", 3).alias("SD WTP"))


# --------------------------------------------------------------------------- importance


def attribute_importance(worths: DataFrame, ratings: DataFrame, survey: Survey) -> DataFrame:
    """Utility range per attribute (price: slope times the observed price range) and its share."""
    ranges = worths.where(F.col("Attribute") != PRICE).groupBy("Attribute").agg(
        F.max("Part_Worth").alias("Max_Part_Worth"), F.min("Part_Worth").alias("Min_Part_Worth"),
        (F.max("Part_Worth") - F.min("Part_Worth")).alias("Utility_Range"))
    span = ratings.agg(F.min(survey.price).alias("lo"), F.max(survey.price).alias("hi"))
    slope = F.col("Part_Worth")
    price = worths.where(F.col("Attribute") == PRICE).crossJoin(F.broadcast(span)).select(
        "Attribute", (slope * F.col("lo")).alias("Max_Part_Worth"), (slope * F.col("hi")).alias("Min_Part_Worth"),
        (F.abs(slope) * (F.col("hi") - F.col("lo"))).alias("Utility_Range"))
    both = price.unionByName(ranges)
    total = F.sum("Utility_Range").over(W.partitionBy(F.lit(1)))
    return (
        both.withColumn("Importance", ratio(F.col("Utility_Range"), total))
        .withColumn("Importance_Percent", percent_label(F.col("Importance")))
        .orderBy(F.desc("Importance"), "Attribute")
    )


def importance_report(importance: DataFrame) -> DataFrame:
    return importance.select(
        "Attribute", F.round("Utility_Range", 3).alias("Utility range"), F.col("Importance_Percent").alias("Importance (%)"))


# --------------------------------------------------------------------------- choice shares


def predict_utility(profiles: DataFrame, fit: OlsFit, survey: Survey) -> DataFrame:
    """Fitted rating of each profile; null for an unlisted level."""
    dummies = survey.dummies()
    terms = [F.lit(float(fit.coefficient(survey.price))) * F.col(survey.price).cast("double")]
    terms += [F.lit(float(fit.coefficient(n))) * c for n, c in dummies.items()]
    return profiles.withColumn("Predicted_Utility", add_up([F.lit(float(fit.intercept)), *terms]))


def logit_share(utilities: DataFrame, sets: Sequence[str] = (), utility: str = "Predicted_Utility") -> DataFrame:
    """Share of each alternative in its choice set, by the logit rule shifted by the set's best.

    The utilities are written once, whatever they come from. Exponents are added per whole part of
    the utility first, so one small table per set holds its best and its total, and one join
    brings them back; no set is ever gathered into one task.
    """
    kept, u = written(utilities), F.col(utility)
    parts = kept.where(u.isNotNull()).withColumn("__whole", F.floor(u)).groupBy(*sets, "__whole").agg(F.sum(F.exp(u - F.col("__whole"))).alias("__part"))
    whole = F.struct(F.col("__whole").alias("w"), F.col("__part").alias("p"))
    scale = parts.groupBy(*sets).agg(F.max("__whole").alias("__best"), F.collect_list(whole).alias("__parts"))
    # a utility's whole parts are few: their number is bounded by the range of utilities, not by the set's size
    summed = F.aggregate("__parts", F.lit(0.0), lambda a, x: a + x["p"] * F.exp((x["w"] - F.col("__best")).cast("double")))
    total = scale.withColumn("__total", summed).drop("__parts")
    share = ratio(F.exp(u - F.col("__best")), F.col("__total"))
    out = join_on_keys(kept, total, sets).withColumn("Predicted_Market_Share", share)
    return out.withColumns({
        "Exp_Utility": F.exp(u),
        "Predicted_Market_Share_Percent": percent_label(F.col("Predicted_Market_Share")),
    }).drop("__best", "__total")


def share_report(shares: DataFrame, description: str = "Description", sets: Sequence[str] = ()) -> DataFrame:
    return shares.select(
        *sets, "Product", description, F.round("Predicted_Utility", 3).alias("Predicted utility"),
        F.col("Predicted_Market_Share_Percent").alias("Predicted market share"))


def proposed_share(shares: DataFrame, proposed: str, sets: Sequence[str] = ()) -> DataFrame:
    return shares.where(F.col("Product") == proposed).select(
        *sets, "Product", "Predicted_Utility", "Predicted_Market_Share", "Predicted_Market_Share_Percent")


def utility_gap(shares: DataFrame, proposed: str, price_slope: float, sets: Sequence[str] = ()) -> DataFrame:
    """Utility lead of the proposed product over each alternative, also as money."""
    own = shares.where(F.col("Product") == proposed).groupBy(*sets).agg(F.max("Predicted_Utility").alias("__own"))
    gap = F.col("__own") - F.col("Predicted_Utility")
    return join_on_keys(shares, own, sets, "left").withColumns({
        "Utility_Gap_vs_Proposed": gap,
        "WTP_Equivalent_Gap": quotient_with_infinity(gap, F.lit(abs(price_slope))),
    }).drop("__own")


def closest_competitor(gaps: DataFrame, proposed: str, sets: Sequence[str] = ()) -> DataFrame:
    """The best alternative besides the proposed product, one row per choice set."""
    columns = ["Product", "Predicted_Utility", "Utility_Gap_vs_Proposed", "WTP_Equivalent_Gap"]
    order = F.struct((-F.col("Predicted_Utility")).alias("u"), "Product")
    best = gaps.where(F.col("Product") != proposed).groupBy(*sets).agg(F.min_by(F.struct(*columns), order).alias("b"))
    return best.select(*sets, "b.*")


def gap_report(closest: DataFrame, sets: Sequence[str] = ()) -> DataFrame:
    return closest.select(
        *sets,
        F.col("Product").alias("Closest competitor"),
        F.round("Predicted_Utility", 3).alias("Competitor utility"),
        F.round("Utility_Gap_vs_Proposed", 3).alias("Utility advantage of proposed product"),
        currency_label(F.col("WTP_Equivalent_Gap"), 2).alias("WTP-equivalent advantage (£)"))
