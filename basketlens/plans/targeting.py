"""Clustered customers to ranked prospects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import presets
from ..operators import anova, discriminant
from ..session import written


def target_prospects(
    clustered: DataFrame, prospects: DataFrame, labels: DataFrame, train_share: float = 0.70, seed: int = 1,
    variables: Sequence[str] = tuple(presets.DEMOGRAPHICS), label_names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """ANOVA of the clusters, a discriminant model with its test results, and scored prospects."""
    separation = anova.anova_oneway(clustered, "KMeans_Cluster", presets.ANOVA_VARIABLES)
    members = discriminant.lda_input(clustered, variables)
    split = written(discriminant.stratified_split(members, "KMeans_Cluster", "CustomerID", train_share, seed=seed))
    train, test = split.where("is_train"), split.where("not is_train")
    scaler = discriminant.fit_scaler(train, variables)
    fit = discriminant.lda_fit(scaler.apply(train), "KMeans_Cluster", variables)
    predictions = written(fit.predict(scaler.apply(test)).drop("is_train"))
    cells = discriminant.confusion_matrix(predictions, fit.classes)
    scored = discriminant.score_prospects(prospects, fit, scaler, labels)
    targeted = written(discriminant.target_priority(scored, label_names))
    return {
        "anova_cluster_separation_results": separation,
        "anova_report_table": anova.anova_report(separation),
        "lda_test_predictions": predictions,
        "lda_confusion_matrix": cells,
        "lda_class_metrics": discriminant.class_metrics(cells),
        "prospect_targeting_lda_predictions": targeted,
        "prospect_cluster_summary": discriminant.prospect_cluster_summary(targeted),
        "prospect_priority_summary": discriminant.priority_summary(targeted),
        "top_prospect_targets": discriminant.top_targets(targeted),
    }
