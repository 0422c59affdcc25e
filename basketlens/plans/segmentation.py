"""Transactions to scored, clustered and labelled customers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..functions import presets
from ..operators import clustering, features, quality, regression, rfm
from ..session import written


@dataclass(frozen=True)
class SegmentationSettings:
    """Parameters of the study. ``exclusion`` is the documented removal of confirmed bad lines."""

    focus: Column
    exclusion: Column | None = None
    clusters: int = 4
    starts: int = 50
    seed: int = 1
    micro_clusters: int = clustering.MICRO_CLUSTERS
    variables: Sequence[str] = tuple(presets.CLUSTER_VARIABLES)
    focus_name: str = "focus"


@dataclass(frozen=True)
class Segmentation:
    lines: DataFrame
    customers: DataFrame
    clustered: DataFrame
    labels: DataFrame
    tables: dict[str, DataFrame]


def influence_review(lines: DataFrame, focus: Column) -> DataFrame:
    """Cook's distance of every customer before any exclusion."""
    customers = features.customer_features_initial(lines, focus)
    fit = regression.ols_fit(customers, "LogMonetary", presets.INFLUENCE_PREDICTORS)
    return regression.cooks_distance(customers, fit)


def segment_customers(raw: DataFrame, settings: SegmentationSettings) -> Segmentation:
    """Clean, build features, score, cluster, profile.

    The cleaned lines and the scored customers are each written once: dozens of later passes
    (percentiles, K-means iterations, profiles) then start from the written copy, and a lost
    executor never repeats the scan of the raw data.
    """
    clean = quality.clean_transactions(raw)
    if settings.exclusion is not None:
        clean = quality.exclude_rows(clean, settings.exclusion)
    lines = written(clean)
    customers = written(features.customer_features(lines, settings.focus))
    scored = written(rfm.score_both(customers))
    comparison = rfm.compare_methods(scored)
    summaries = {m: rfm.segment_summary(scored, m) for m in (rfm.INDEPENDENT, rfm.SEQUENTIAL)}

    scaled = clustering.keep(clustering.standardise(
        clustering.cluster_matrix(features.log_features(scored), settings.variables)))
    model, _ = clustering.kmeans_best_of(scaled, settings.clusters, settings.starts, settings.seed)
    with_kmeans = written(clustering.renumber_by_value(clustering.attach_clusters(scaled, model)))
    with_ward, _ = clustering.ward_clusters(with_kmeans, settings.clusters, settings.micro_clusters)
    clustered = written(with_ward.drop(clustering.FEATURES, clustering.SCALED))
    labels = clustering.label_clusters(clustered, labels=presets.cluster_labels(settings.focus_name))
    labelled = clustering.with_labels(clustered, labels)

    tables = {
        "customer_data_rfm": scored,
        "rfm_independent_table": rfm.score_cells(scored, rfm.INDEPENDENT),
        "rfm_sequential_table": rfm.score_cells(scored, rfm.SEQUENTIAL),
        "rfm_independent_segment_summary": summaries[rfm.INDEPENDENT],
        "rfm_sequential_segment_summary": summaries[rfm.SEQUENTIAL],
        "rfm_method_comparison": comparison,
        "customer_data_clustered": labelled,
        "cluster_profile_summary": clustering.profile_labelled(clustering.cluster_profile(clustered), labels),
        "cluster_rfm_mix": clustering.cluster_segment_mix(clustered),
    }
    return Segmentation(lines, customers, labelled, labels, tables)
