"""Principal components of product attributes and the product map built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.scalars import first_matching_label, leading_word, percent_label
from .regression import add_up


@dataclass(frozen=True)
class PcaFit:
    """Fitted components; p×k numbers. Each component's largest loading is positive."""

    variables: list[str]
    n: int
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray       # variables x components
    eigenvalues: np.ndarray
    total_variance: float

    @property
    def components(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.loadings.shape[1])]

    def score_columns(self, k: int | None = None) -> dict[str, Column]:
        """Component scores as plain column arithmetic, for training and new rows alike."""
        z = [(F.col(v).cast("double") - F.lit(float(m))) / F.lit(float(s))
             for v, m, s in zip(self.variables, self.mean, self.sd)]
        names = self.components[: k or len(self.components)]
        return {c: add_up([F.lit(float(w)) * x for w, x in zip(self.loadings[:, i], z)]) for i, c in enumerate(names)}

    def pve(self, spark: SparkSession) -> DataFrame:
        """Singular value, deviation, eigenvalue, share and cumulative share of variance per component."""
        rows, running = [], 0.0
        for name, e in zip(self.components, self.eigenvalues):
            share = float(e / self.total_variance)
            running += share
            sd = float(np.sqrt(e))
            rows.append((name, sd * float(np.sqrt(self.n - 1)), sd, float(e), share, running))
        return spark.createDataFrame(
            rows, "PC string, Singular_Value double, PC_Standard_Deviation double, Eigenvalue double, PVE double, Cumulative_PVE double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        """One row per variable, one column per component."""
        rows = [(v, *[float(x) for x in self.loadings[i]]) for i, v in enumerate(self.variables)]
        return spark.createDataFrame(rows, "Variable string, " + ", ".join(f"{c} double" for c in self.components))


def _oriented(loadings: np.ndarray) -> np.ndarray:
    largest = np.argmax(np.abs(loadings) - 1e-9 * np.arange(len(loadings))[:, None], axis=0)
    return loadings * np.where(loadings[largest, range(loadings.shape[1])] < 0, -1.0, 1.0)


def pca_fit(df: DataFrame, variables: Sequence[str], k: int | None = None) -> PcaFit:
    """PCA of the centred and scaled variables. Constant variables raise, missing values fail the job."""
    variables = list(variables)
    p = len(variables)
    doubles = df.select(*[F.col(v).cast("double").alias(v) for v in variables])
    assembled = VectorAssembler(inputCols=variables, outputCol="features", handleInvalid="error").transform(doubles)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(assembled)
    sd = np.array(scaler.std)
    flat = [v for v, s in zip(variables, sd) if not s > 0]
    if flat:
        raise ValueError(f"constant columns: {flat}")
    n = df.count()
    model = PCA(k=min(k or p, p), inputCol="scaled", outputCol="pc").fit(scaler.transform(assembled))
    # scaled variables have unit variance, so the total is p
    eigenvalues = np.array(model.explainedVariance) * p
    return PcaFit(variables, n, np.array(scaler.mean), sd, _oriented(model.pc.toArray()), eigenvalues, float(p))


def missing_by_variable(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(v).isNull()).alias(v) for v in variables])
    return counts.unpivot([], list(variables), "Variable", "Missing")


def pve_report(pve: DataFrame) -> DataFrame:
    return pve.select(
        F.col("PC").alias("Principal component"),
        F.round("Singular_Value", 3).alias("Singular value"),
        F.round("Eigenvalue", 3).alias("Eigenvalue"),
        percent_label(F.col("PVE")).alias("PVE (%)"),
        percent_label(F.col("Cumulative_PVE")).alias("Cumulative PVE (%)"),
    )


def loading_report(loadings: DataFrame, k: int = 4) -> DataFrame:
    names = [c for c in loadings.columns if c != "Variable"][:k]
    return loadings.select("Variable", *[F.round(c, 3).alias(c) for c in names])


def loading_arrows(loadings: DataFrame, scale: float = 3.0) -> DataFrame:
    return loadings.withColumns({"PC1_scaled": F.col("PC1") * scale, "PC2_scaled": F.col("PC2") * scale})


def variable_importance(loadings: DataFrame) -> DataFrame:
    """Contribution of each variable to the first two components."""
    return loadings.select(
        "Variable", "PC1", "PC2",
        (F.col("PC1") * F.col("PC1")).alias("PC1_Contribution"),
        (F.col("PC2") * F.col("PC2")).alias("PC2_Contribution"),
        (F.col("PC1") * F.col("PC1") + F.col("PC2") * F.col("PC2")).alias("PC1_PC2_Contribution"),
    ).orderBy(F.desc("PC1_PC2_Contribution"), "Variable")


def variable_importance_report(importance: DataFrame) -> DataFrame:
    return importance.select(
        "Variable",
        F.round("PC1", 3).alias("PC1 loading"),
        F.round("PC2", 3).alias("PC2 loading"),
        F.round("PC1_PC2_Contribution", 3).alias("PC1² + PC2²"),
    )


def product_scores(df: DataFrame, fit: PcaFit, keep: Sequence[str] = ("product_name",), k: int | None = None) -> DataFrame:
    """Component scores per product; also projects new products into the fitted space."""
    return df.select(*keep, *[c.alias(name) for name, c in fit.score_columns(k).items()])


def brand_from_name(scores: DataFrame, name: str = "product_name") -> DataFrame:
    return scores.withColumn("Brand", leading_word(F.col(name)))


def brand_by_rules(scores: DataFrame, rules: Sequence[tuple[str, str]] = tuple(presets.BRAND_RULES),
                   name: str = "product_name", default: str = "Other") -> DataFrame:
    return scores.withColumn("Brand", first_matching_label(F.col(name), rules, default))


def in_zone(scores: DataFrame, zone: Mapping[str, tuple[float, float]] = presets.TARGET_ZONE) -> DataFrame:
    """Whether a product lies in the target zone of the map."""
    inside = F.lit(True)
    for axis, (low, high) in zone.items():
        inside = inside & F.col(axis).between(low, high)
    return scores.withColumn("In_Zone", inside)


def cluster_scores(scaled: DataFrame, key: str, cluster: str = "KMeans_Cluster") -> DataFrame:
    """First two components of already scaled cluster vectors, per customer."""
    model = PCA(k=2, inputCol="scaled", outputCol="__pc").fit(scaled)
    raw = model.pc.toArray()
    sign = [float(s) for s in np.sign((_oriented(raw) * raw).sum(axis=0))]
    pc = vector_to_array("__pc")
    return model.transform(scaled).select(
        key, (F.get(pc, F.lit(0)) * sign[0]).alias("PC1"), (F.get(pc, F.lit(1)) * sign[1]).alias("PC2"), cluster)
