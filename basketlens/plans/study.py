"""The full study: every result table, written under one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import presets
from ..operators import conjoint
from ..sources.writers import publish_tables, write_tables
from .product_design import conjoint_tables
from .segmentation import SegmentationSettings, segment_customers
from .targeting import target_prospects

# tables whose size is set by parameters, written as one file each
REPORT_TABLES = (
    "rfm_independent_table", "rfm_sequential_table", "rfm_independent_segment_summary", "rfm_sequential_segment_summary",
    "cluster_profile_summary", "cluster_rfm_mix", "anova_cluster_separation_results", "anova_report_table",
    "lda_confusion_matrix", "lda_class_metrics", "prospect_cluster_summary", "prospect_priority_summary",
    "average_conjoint_partworths", "respondent_partworth_summary", "average_wtp", "respondent_wtp_summary",
    "partworth_report_table", "wtp_report_table", "conjoint_attribute_importance",
    "conjoint_attribute_importance_report_table",
)


def run_study(
    transactions: DataFrame, prospects: DataFrame, ratings: DataFrame, market: DataFrame, proposed: str,
    settings: SegmentationSettings, survey: conjoint.Survey = conjoint.Survey(), sets: Sequence[str] = (),
    description: str = "Description",
) -> dict[str, DataFrame]:
    """The thirty-three result tables by name."""
    segmentation = segment_customers(transactions, settings)
    targeting = target_prospects(
        segmentation.clustered, prospects, segmentation.labels, seed=settings.seed,
        label_names=presets.cluster_labels(settings.focus_name))
    design = conjoint_tables(ratings, market, proposed, survey, sets, description)
    return {**segmentation.tables, **targeting, **design}


def write_study(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """Every table in a folder of its name; see ``publish_study`` for a set that is replaced as a whole."""
    return write_tables(tables, folder, fmt, REPORT_TABLES)


def publish_study(tables: dict[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """Publishes the tables as one set: readers see all of the new ones or all of the old ones."""
    return publish_tables(tables, folder, fmt, REPORT_TABLES)
