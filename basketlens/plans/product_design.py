"""Rated profiles to part-worths, willingness to pay and predicted shares; attributes to a map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import presets
from ..operators import conjoint, positioning
from ..session import written


def conjoint_tables(
    raw_ratings: DataFrame, market: DataFrame, proposed: str, survey: conjoint.Survey = conjoint.Survey(),
    sets: Sequence[str] = (), description: str = "Description",
) -> dict[str, DataFrame]:
    """All conjoint result tables. ``market`` holds the alternatives of each choice set."""
    spark = raw_ratings.sparkSession
    ratings = written(conjoint.prepare_ratings(raw_ratings, survey))
    fit = conjoint.pooled_fit(ratings, survey)
    average = conjoint.part_worths(spark, fit, survey)
    coefficients = written(conjoint.respondent_coefficients(ratings, survey))
    worths = conjoint.respondent_part_worths(coefficients, survey)
    worth_summary = conjoint.part_worth_summary(worths)
    clean_wtp = written(conjoint.trimmed_wtp(conjoint.respondent_wtp(coefficients, survey)))
    money_summary = conjoint.wtp_summary(clean_wtp)
    importance = conjoint.attribute_importance(average, ratings, survey)
    shares = written(conjoint.logit_share(conjoint.predict_utility(market, fit, survey), sets))
    gaps = conjoint.utility_gap(shares, proposed, fit.coefficient(survey.price), sets)
    order = [F.desc("Predicted_Market_Share"), "Product"]
    return {
        "average_conjoint_partworths": average,
        "respondent_conjoint_partworths": worths,
        "respondent_partworth_summary": worth_summary,
        "average_wtp": conjoint.average_wtp(average),
        "respondent_level_wtp_clean": clean_wtp,
        "respondent_wtp_summary": money_summary,
        "partworth_report_table": conjoint.part_worth_report(worth_summary),
        "wtp_report_table": conjoint.wtp_report(money_summary),
        "conjoint_attribute_importance": importance,
        "conjoint_attribute_importance_report_table": conjoint.importance_report(importance),
        "conjoint_market_share_gap_analysis": gaps,
        "closest_competitor_gap_report_table": conjoint.gap_report(conjoint.closest_competitor(gaps, proposed, sets), sets),
        "conjoint_market_share_prediction": shares.orderBy(*order),
        "conjoint_market_share_report_table": conjoint.share_report(shares.orderBy(*order), description, sets),
        "proposed_product_market_share": conjoint.proposed_share(shares, proposed, sets),
    }


@dataclass(frozen=True)
class ProductMap:
    fit: positioning.PcaFit
    pve: DataFrame
    loadings: DataFrame
    importance: DataFrame
    scores: DataFrame
    new_scores: DataFrame | None


def product_map(products: DataFrame, new_products: DataFrame | None = None,
                variables: Sequence[str] = tuple(presets.PRODUCT_ATTRIBUTES)) -> ProductMap:
    """Components of the product attributes, every product's place, brand and zone, and new products beside them."""
    spark = products.sparkSession
    fit = positioning.pca_fit(products, variables)
    loadings = fit.loading_table(spark)
    place = lambda df: positioning.in_zone(positioning.brand_by_rules(positioning.product_scores(df, fit)))
    return ProductMap(
        fit, fit.pve(spark), loadings, positioning.variable_importance(loadings), place(products),
        place(new_products) if new_products is not None else None,
    )
