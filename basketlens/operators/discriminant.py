"""Linear discriminant analysis and prospect targeting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.moments import collect_group_moments, invert_spd
from ..functions.scalars import mean_of, percent_label, ratio, total_of
from ..functions.tails import binomial_upper_column
from .features import group_shares
from .rank import lowest_share, summarise
from .regression import add_up

# --------------------------------------------------------------------------- input


def lda_input(customers: DataFrame, variables: Sequence[str] = tuple(presets.DEMOGRAPHICS),
              cluster: str = "KMeans_Cluster") -> DataFrame:
    return customers.select("CustomerID", cluster, "Cluster_Label", *variables)


def input_check(df: DataFrame, rows: str, cluster: str | None = None) -> DataFrame:
    """Rows, missing values over all columns, and classes where there are any."""
    missing = add_up([F.col(c).isNull().cast("int") for c in df.columns])
    out = [F.count(F.lit(1)).alias(rows), F.coalesce(F.sum(missing), F.lit(0)).alias("Missing_Values")]
    if cluster:
        out.append(F.count_distinct(cluster).alias("Clusters"))
    return df.agg(*out)


def hash_key(id_column: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_column), F.lit(seed))


def stratified_split(
    df: DataFrame, label: str, id_column: str, p: float = 0.70, key: Column | None = None, seed: int = 1,
    slices: int | None = None,
) -> DataFrame:
    """Add ``is_train``: per class the ceil(p*n) rows with the lowest hash key, ties by id.

    Exact and repeatable.
    """
    ordered = df.withColumn("__key", key if key is not None else hash_key(id_column, seed))
    return lowest_share(ordered, label, ["__key", id_column], p, "is_train", slices).drop("__key")


def class_shares(df: DataFrame, label: str = "KMeans_Cluster") -> DataFrame:
    return group_shares(df, label, label=None)


# --------------------------------------------------------------------------- predictors


@dataclass(frozen=True)
class Scaler:
    """Centre and deviation of numeric predictors, learnt on the training rows."""

    mean: dict[str, float]
    sd: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.sd[c]) for c in self.mean})


def numeric_columns(df: DataFrame, variables: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [v for v in variables if types[v] != "string"]


def fit_scaler(train: DataFrame, variables: Sequence[str]) -> Scaler:
    numeric = numeric_columns(train, variables)
    row = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(F.col(c).cast("double")).alias("s")).alias(c)
                      for c in numeric]).first()
    flat = [c for c in numeric if not row[c]["s"]]
    if flat:
        raise ValueError(f"constant columns: {flat}")
    return Scaler({c: float(row[c]["m"]) for c in numeric}, {c: float(row[c]["s"]) for c in numeric})


def text_levels(train: DataFrame, variables: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of the text predictors; the first is the base. Each level is a column of the model."""
    text = [v for v in variables if dict(train.dtypes)[v] == "string"]
    levels = {}
    for v in text:
        levels[v] = [r[0] for r in train.select(v).where(F.col(v).isNotNull()).distinct().orderBy(v).collect()]
    return levels


def predictor_columns(variables: Sequence[str], levels: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Numbers as they are; each text level but the first as a 0/1 column."""
    out: dict[str, Column] = {}
    for v in variables:
        if v in levels:
            for level in levels[v][1:]:
                out[f"{v}_{level}"] = (F.col(v) == level).cast("double")
        else:
            out[v] = F.col(v).cast("double")
    return out


# --------------------------------------------------------------------------- model


def posterior(scored: DataFrame, classes: Sequence, prefix: str) -> DataFrame:
    """Class, posteriors and the largest one from the linear scores ``__d0, __d1...`` of the classes, which are dropped."""
    k = range(len(classes))
    scored = scored.withColumn("__best", F.greatest(*[f"__d{i}" for i in k]))
    scored = scored.withColumns({f"__w{i}": F.exp(F.col(f"__d{i}") - F.col("__best")) for i in k})
    scored = scored.withColumn("__total", add_up([F.col(f"__w{i}") for i in k]))
    first_best = F.when(F.col("__d0") == F.col("__best"), F.lit(classes[0]))
    for i in k[1:]:
        first_best = first_best.when(F.col(f"__d{i}") == F.col("__best"), F.lit(classes[i]))
    return scored.withColumns({
        "Predicted_Cluster": first_best,
        **{f"{prefix}{c}": F.col(f"__w{i}") / F.col("__total") for i, c in enumerate(classes)},
        "Max_Cluster_Probability": F.greatest(*[f"__w{i}" for i in k]) / F.col("__total"),
    }).drop("__best", "__total", *[f"__{x}{i}" for x in "dw" for i in k])


@dataclass(frozen=True)
class LdaFit:
    """Class priors, means and linear scores; classes x predictors numbers."""

    label: str
    classes: list
    variables: list[str]
    levels: dict[str, list[str]]
    names: list[str]
    counts: np.ndarray
    means: np.ndarray
    pooled: np.ndarray
    coefficients: np.ndarray = field(repr=False)
    constants: np.ndarray = field(repr=False)

    @property
    def priors(self) -> np.ndarray:
        return self.counts / self.counts.sum()

    def score_columns(self) -> list[Column]:
        x = list(predictor_columns(self.variables, self.levels).values())
        return [add_up([F.lit(float(k)), *[F.lit(float(w)) * c for w, c in zip(ws, x)]])
                for ws, k in zip(self.coefficients, self.constants)]

    def predict(self, df: DataFrame, prefix: str = "Cluster_Probability_") -> DataFrame:
        """Class, posterior per class and the largest posterior. A narrow projection.

        The class is the first one with the highest score; all are null if a predictor is.
        """
        return posterior(df.withColumns({f"__d{i}": c for i, c in enumerate(self.score_columns())}), self.classes, prefix)

    def prior_table(self, spark: SparkSession) -> DataFrame:
        rows = [(str(c), int(n), float(p)) for c, n, p in zip(self.classes, self.counts, self.priors)]
        return spark.createDataFrame(rows, "Cluster string, n long, Prior double")

    def mean_table(self, spark: SparkSession) -> DataFrame:
        rows = [(str(c), v, float(m)) for c, row in zip(self.classes, self.means) for v, m in zip(self.names, row)]
        return spark.createDataFrame(rows, "Cluster string, Variable string, Mean double")

    def _discriminants(self) -> tuple[np.ndarray, np.ndarray]:
        g, n = len(self.classes), self.counts.sum()
        centre = self.priors @ self.means
        between = (self.means - centre).T @ np.diag(self.counts) @ (self.means - centre) / (g - 1)
        values, vectors = np.linalg.eigh(self.pooled)
        whiten = vectors / np.sqrt(values)
        eigenvalues, rotation = np.linalg.eigh(whiten.T @ between @ whiten)
        order = np.argsort(eigenvalues)[::-1][: min(g - 1, len(self.names))]
        scaling = whiten @ rotation[:, order]
        largest = np.argmax(np.abs(scaling), axis=0)
        return scaling * np.where(scaling[largest, range(len(order))] < 0, -1.0, 1.0), eigenvalues[order]

    def discriminant_table(self, spark: SparkSession) -> DataFrame:
        """Coefficients of the linear discriminants, within-class spherical, largest coefficient positive."""
        scaling, _ = self._discriminants()
        rows = [(v, f"LD{j + 1}", float(scaling[i, j])) for i, v in enumerate(self.names) for j in range(scaling.shape[1])]
        return spark.createDataFrame(rows, "Variable string, Discriminant string, Coefficient double")

    def trace_table(self, spark: SparkSession) -> DataFrame:
        """Share of the between-class variance that each discriminant carries."""
        _, eigenvalues = self._discriminants()
        shares = eigenvalues / eigenvalues.sum()
        rows = [(f"LD{j + 1}", float(e), float(s)) for j, (e, s) in enumerate(zip(eigenvalues, shares))]
        return spark.createDataFrame(rows, "Discriminant string, Eigenvalue double, Trace_Share double")


def lda_fit(train: DataFrame, label: str, variables: Sequence[str],
            levels: Mapping[str, Sequence[str]] | None = None) -> LdaFit:
    """Priors, class means and the pooled covariance from one aggregate by class; p×p algebra on the driver."""
    variables = list(variables)
    known = {k: list(v) for k, v in (levels if levels is not None else text_levels(train, variables)).items()}
    columns = predictor_columns(variables, known)
    names = list(columns)
    prepared = train.select(F.col(label), *[c.alias(f"x{i}") for i, c in enumerate(columns.values())])
    groups = collect_group_moments(prepared, label, [f"x{i}" for i in range(len(names))])
    if len(groups) < 2:
        raise ValueError("fewer than two classes")
    counts = np.array([m.n for m in groups.values()])
    means = np.array([m.mean for m in groups.values()])
    pooled = sum((m.n - 1) * m.cov for m in groups.values()) / (counts.sum() - len(groups))
    inverse = invert_spd(pooled, names)
    coefficients = means @ inverse
    constants = -0.5 * np.einsum("ij,ij->i", coefficients, means) + np.log(counts / counts.sum())
    return LdaFit(label, list(groups), variables, known, names, counts, means, pooled, coefficients, constants)


# --------------------------------------------------------------------------- evaluation


def confusion_matrix(predictions: DataFrame, classes: Sequence, actual: str = "KMeans_Cluster",
                     predicted: str = "Predicted_Cluster") -> DataFrame:
    """Customers per (predicted, actual), every cell of the classes present, others (such as no prediction) as they occur."""
    counts = predictions.groupBy(F.col(predicted).alias("Predicted_Cluster"), F.col(actual).alias("Actual_Cluster")).agg(
        F.count(F.lit(1)).alias("Customers"))
    kind = predictions.schema[actual].dataType.simpleString()
    grid = predictions.sparkSession.createDataFrame(
        [(p, a) for a in classes for p in classes], f"Predicted_Cluster {kind}, Actual_Cluster {kind}")
    known = grid.join(counts, ["Predicted_Cluster", "Actual_Cluster"], "left").fillna(0, ["Customers"])
    listed = lambda c: F.coalesce(F.col(c).isin(list(classes)), F.lit(False))
    return known.unionByName(counts.where(~(listed("Predicted_Cluster") & listed("Actual_Cluster"))))


def overall_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, kappa, no-information rate and its one-sided binomial p, from g*g cells."""
    hit = F.when(F.col("Predicted_Cluster") == F.col("Actual_Cluster"), F.col("Customers")).otherwise(0)
    rows = cells.groupBy(F.col("Predicted_Cluster").alias("c")).agg(F.sum("Customers").alias("predicted"), F.sum(hit).alias("hits"))
    columns = cells.groupBy(F.col("Actual_Cluster").alias("c")).agg(F.sum("Customers").alias("actual"))
    totals = rows.join(F.broadcast(columns), "c").agg(
        F.sum("hits").alias("hits"), F.sum("actual").alias("n"), F.max("actual").alias("largest"),
        F.sum(F.col("predicted").cast("double") * F.col("actual")).alias("chance"))
    rate = ratio(F.col("largest"), F.col("n"))
    accuracy = ratio(F.col("hits"), F.col("n"))
    expected = ratio(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return totals.select(
        accuracy.alias("Accuracy"),
        ratio(accuracy - expected, F.lit(1.0) - expected).alias("Kappa"),
        rate.alias("No_Information_Rate"),
        binomial_upper_column("hits", "n", rate).alias("Accuracy_P_Value"),
    )


def class_metrics(cells: DataFrame, digits: int = 3) -> DataFrame:
    """Sensitivity, specificity, predictive values and balanced accuracy per class; null on a zero denominator."""
    hit = F.when(F.col("Predicted_Cluster") == F.col("Actual_Cluster"), F.col("Customers")).otherwise(0)
    rows = cells.groupBy(F.col("Predicted_Cluster").alias("Cluster")).agg(F.sum("Customers").alias("p"), F.sum(hit).alias("tp"))
    columns = cells.groupBy(F.col("Actual_Cluster").alias("Cluster")).agg(F.sum("Customers").alias("a"))
    total = cells.agg(F.sum("Customers").alias("n"))
    t = rows.join(F.broadcast(columns), "Cluster").crossJoin(F.broadcast(total))
    n, p, a, tp = (F.col(c) for c in ("n", "p", "a", "tp"))
    sensitivity, specificity = ratio(tp, a), ratio(n - p - a + tp, n - a)
    return t.select(
        "Cluster",
        F.round(sensitivity, digits).alias("Sensitivity"),
        F.round(specificity, digits).alias("Specificity"),
        F.round(ratio(tp, p), digits).alias("Pos Pred Value"),
        F.round(ratio(n - p - a + tp, n - p), digits).alias("Neg Pred Value"),
        F.round((sensitivity + specificity) / 2, digits).alias("Balanced Accuracy"),
    )


# --------------------------------------------------------------------------- prospects


def score_prospects(prospects: DataFrame, fit: LdaFit, scaler: Scaler | None, labels: DataFrame,
                    cluster: str = "KMeans_Cluster") -> DataFrame:
    """Predicted class with label for each prospect; the raw attributes ride along, so no re-join.

    Scaled values are computed beside the raw ones and dropped after scoring.
    """
    raw = list(scaler.mean) if scaler else []
    kept = prospects.withColumns({f"__raw_{c}": F.col(c) for c in raw})
    scored = fit.predict(scaler.apply(kept) if scaler else kept)
    restored = scored.withColumns({c: F.col(f"__raw_{c}") for c in raw}).drop(*[f"__raw_{c}" for c in raw])
    names = labels.select(F.col(cluster).alias("__c"), F.col("Cluster_Label").alias("Predicted_Cluster_Label"))
    return restored.join(F.broadcast(names), F.col("Predicted_Cluster") == F.col("__c"), "left").drop("__c")


def rejoin_attributes(scored: DataFrame, prospects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach raw attributes to separately stored predictions by customer key."""
    return scored.join(prospects.select("CustomerID", *columns), "CustomerID", "left")


def target_priority(scored: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    names = labels or presets.cluster_labels()
    label = F.col("Predicted_Cluster_Label")
    return scored.withColumn(
        "Target_Priority",
        F.when(label == names["loyal"], "Primary target").when(label == names["committed"], "Secondary target")
        .otherwise("Lower priority"),
    )


def prospect_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prospects, share, mean top probability and median attributes per group."""
    groups = summarise(
        scored,
        [F.count(F.lit(1)).alias("Prospects"), mean_of(F.col("Max_Cluster_Probability")).alias("Avg_Max_Probability")],
        {"Median_Income": "Income", "Median_Age": "Age", "Median_HouseholdSize": "HouseholdSize"},
        by=list(keys),
    )
    return groups.select(
        *keys, "Prospects", ratio(F.col("Prospects"), total_of("Prospects")).alias("Prospect_Share"), "Avg_Max_Probability",
        "Median_Income", "Median_Age", "Median_HouseholdSize",
    ).orderBy(F.desc("Prospects"), *keys)


def prospect_cluster_summary(scored: DataFrame) -> DataFrame:
    return prospect_summary(scored, ["Predicted_Cluster", "Predicted_Cluster_Label"])


def prospect_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("Predicted_Cluster").alias("Predicted cluster"),
        F.col("Predicted_Cluster_Label").alias("Cluster label"),
        "Prospects",
        percent_label(F.col("Prospect_Share")).alias("Share"),
        percent_label(F.col("Avg_Max_Probability")).alias("Avg prediction probability"),
        F.col("Median_Income").alias("Median income (£000s)"),
        F.col("Median_Age").alias("Median age"),
        F.col("Median_HouseholdSize").alias("Median household size"),
    )


def priority_summary(targeted: DataFrame) -> DataFrame:
    return prospect_summary(targeted, ["Target_Priority"])


# The reported columns of a target, in order.
TARGET_COLUMNS = [
    "CustomerID", "Target_Priority", "Predicted_Cluster", "Predicted_Cluster_Label", "Max_Cluster_Probability",
    "Income", "Age", "HouseholdSize", "Married", "Work", "Education",
]


def top_targets(targeted: DataFrame, n: int | None = None) -> DataFrame:
    """Primary, then secondary targets, most certain first; all of them unless ``n`` is given."""
    order = F.when(F.col("Target_Priority") == "Primary target", 1).otherwise(2)
    chosen = targeted.where(F.col("Target_Priority").isin("Primary target", "Secondary target")).select(*TARGET_COLUMNS)
    ranked = chosen.orderBy(order, F.desc("Max_Cluster_Probability"), "CustomerID")
    return ranked.limit(n) if n is not None else ranked
