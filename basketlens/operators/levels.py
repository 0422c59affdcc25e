"""Discriminants with text predictors of any number of levels.

A level is a row of a table, never a column of a model: sums per level and per pair of levels that occur together stand for the
design, and conjugate gradients solve the pooled within-class covariance for all classes at once. A pass joins the pairs with the
current directions and adds up by level; only classes x classes numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled, written
from .discriminant import numeric_columns, posterior
from .regression import add_up

KEY = ["v", "level"]


@dataclass(frozen=True)
class LevelFit:
    """Priors and linear scores; ``weights`` has a row per numeric predictor (empty level) and per level: ``v, level, w0, w1...``.

    Weights of an attribute are centred, so that a level that was not seen counts as the average one.
    """

    label: str
    classes: list
    variables: list[str]
    counts: np.ndarray
    weights: DataFrame
    constants: np.ndarray
    numeric: dict[str, np.ndarray]
    centre: dict[str, float]
    steps: int

    def predict(self, df: DataFrame, prefix: str = "Cluster_Probability_") -> DataFrame:
        """Class, posterior per class and the largest posterior; all null if a predictor is."""
        k, kept = range(len(self.classes)), df.columns
        scores = [F.lit(float(c)) for c in self.constants]
        for name, w in self.numeric.items():
            scores = [s + F.lit(float(w[i])) * (F.col(f"`{name}`").cast("double") - F.lit(self.centre[name])) for i, s in enumerate(scores)]
        scored = df
        for v, name in enumerate(self.variables):
            if name not in self.numeric:
                own = self.weights.where(F.col("v") == v).select(F.col("level").alias(f"__l{v}"), *[F.col(f"w{i}").alias(f"__w{v}_{i}") for i in k])
                scored = scored.join(own, F.col(f"`{name}`") == F.col(f"__l{v}"), "left")
                known = F.col(f"`{name}`").isNotNull()
                scores = [s + F.when(known, F.coalesce(F.col(f"__w{v}_{i}"), F.lit(0.0))) for i, s in enumerate(scores)]
        return posterior(scored.select(*[F.col(f"`{c}`") for c in kept], *[s.alias(f"__d{i}") for i, s in enumerate(scores)]), self.classes, prefix)


def _features(df: DataFrame, variables: Sequence[str], numeric: Sequence[str], centre: dict[str, float], scale: dict[str, float]) -> Column:
    cells = []
    for v, name in enumerate(variables):
        c = F.col(f"`{name}`")
        level, x = (F.lit(""), (c.cast("double") - centre[name]) / scale[name]) if name in numeric else (c, F.lit(1.0))
        cells.append(F.struct(F.lit(v).alias("v"), level.alias("level"), x.alias("x")))
    return F.array(*cells)


def lda_fit_levels(train: DataFrame, label: str, variables: Sequence[str], tolerance: float = 1e-12, steps: int = 500) -> LevelFit:
    """The discriminant of ``label``; rows with a null among ``variables`` or as label are left out.

    Stops when the residual of every class is below ``tolerance`` of its right side, and raises if ``steps`` do not suffice, as
    where a predictor does not vary inside any class.
    """
    variables, spark = list(variables), train.sparkSession
    complete = train.dropna(subset=[label, *variables])
    numeric = numeric_columns(complete, variables)
    by_class = {r[label]: r for r in complete.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()}
    classes, counts = list(by_class), np.array([float(r["n"]) for r in by_class.values()])
    if len(classes) < 2:
        raise ValueError("fewer than two classes")
    k, total, free = range(len(classes)), counts.sum(), counts.sum() - len(classes)
    centre, scale = {}, {}
    if numeric:
        row = complete.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{a}{i}") for i, c in enumerate(numeric) for a, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        centre = {c: float(row[f"m{i}"]) for i, c in enumerate(numeric)}
        scale = {c: float(row[f"s{i}"]) or 1.0 for i, c in enumerate(numeric)}

    taken = [0]

    def solve() -> DataFrame:
        features = _features(complete, variables, numeric, centre, scale)
        rows = written(complete.select(F.col(f"`{label}`").alias("label"), features.alias("f")))
        pairs = rows.select("f", F.explode("f").alias("a")).select("a", F.explode("f").alias("b"))
        pairs = written(pairs.groupBy(*[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in KEY]).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("s")))
        sums = rows.select("label", F.inline("f")).groupBy(*KEY).agg(*[
            (F.coalesce(F.sum(F.when(F.col("label") == F.lit(c), F.col("x"))), F.lit(0.0)) / F.lit(float(n))).alias(f"u{i}")
            for i, (c, n) in enumerate(zip(classes, counts))])
        own = pairs.where("av = bv AND alevel = blevel").select(F.col("av").alias("v"), F.col("alevel").alias("level"), "s")
        mean = add_up([F.col(f"u{i}") * F.lit(float(counts[i] / total)) for i in k])
        within = (F.col("s") - add_up([F.lit(float(counts[i])) * F.col(f"u{i}") * F.col(f"u{i}") for i in k])) / F.lit(float(free))
        state = written(sums.join(own, KEY).withColumn("d", F.when(within > 1e-12 * F.col("s") / F.lit(float(free)), within)).withColumn("m", mean).select(
            *KEY, "d", "m", *[f"u{i}" for i in k], *[F.lit(0.0).alias(f"w{i}") for i in k],
            *[(F.col(f"u{i}") - F.col("m")).alias(f"r{i}") for i in k], *[F.lit(0.0).alias(f"p{i}") for i in k]))
        if state.where(F.col("d").isNull() & (F.greatest(*[F.abs(f"r{i}") for i in k]) > 1e-12)).limit(1).count():
            raise ValueError("a predictor differs between classes and does not vary inside any")
        z = [F.when(F.col("d").isNull(), 0.0).otherwise(F.col(f"r{i}") / F.col("d")) for i in k]
        before, first = None, None
        while True:
            # what the next direction z + beta p needs: its scale, and its product with every class mean
            found = state.agg(*[F.sum(F.col(f"r{i}") * z[i]).alias(f"rz{i}") for i in k],
                              *[F.sum(F.col(f"u{c}") * z[i]).alias(f"uz{c}_{i}") for c in k for i in k],
                              *[F.sum(F.col(f"u{c}") * F.col(f"p{i}")).alias(f"up{c}_{i}") for c in k for i in k]).first()
            rz = np.array([found[f"rz{i}"] for i in k])
            first = rz if first is None else first
            going = rz > tolerance ** 2 * first
            if not going.any():
                break
            if taken[0] >= steps:
                raise ValueError(f"no solution after {steps} steps")
            beta = np.zeros(len(classes)) if before is None else np.where(going, rz / np.where(before > 0, before, 1.0), 0.0)
            product = np.array([[found[f"uz{c}_{i}"] + beta[i] * found[f"up{c}_{i}"] for i in k] for c in k])
            turned = state.select(*KEY, "d", "m", *[f"{x}{i}" for x in "uwr" for i in k],
                                  *[(z[i] + F.lit(float(beta[i])) * F.col(f"p{i}")).alias(f"p{i}") for i in k])
            met = pairs.join(turned.select(F.col("v").alias("bv"), F.col("level").alias("blevel"), *[f"p{i}" for i in k]), ["bv", "blevel"])
            met = met.groupBy(F.col("av").alias("v"), F.col("alevel").alias("level")).agg(*[F.sum(F.col("s") * F.col(f"p{i}")).alias(f"q{i}") for i in k])
            q = [(F.col(f"q{i}") - add_up([F.lit(float(counts[c] * product[c, i])) * F.col(f"u{c}") for c in k])) / F.lit(float(free)) for i in k]
            turned = written(turned.join(met, KEY).withColumns({f"q{i}": q[i] for i in k}))
            bent = turned.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")).alias(f"pq{i}") for i in k]).first()
            curve = np.array([bent[f"pq{i}"] for i in k])
            if (going & ~(curve > 0)).any():
                raise ValueError("the covariance inside classes is singular for what tells them apart")
            alpha = np.where(going, rz / np.where(curve > 0, curve, 1.0), 0.0)
            state = turned.select(*KEY, "d", "m", *[f"u{i}" for i in k],
                                  *[(F.col(f"w{i}") + F.lit(float(alpha[i])) * F.col(f"p{i}")).alias(f"w{i}") for i in k],
                                  *[(F.col(f"r{i}") - F.lit(float(alpha[i])) * F.col(f"q{i}")).alias(f"r{i}") for i in k], *[f"p{i}" for i in k])
            before, taken[0] = rz, taken[0] + 1
        return state.select(*KEY, "m", *[f"{x}{i}" for x in "uw" for i in k])

    solved = settled(spark, solve)
    half = solved.agg(*[F.sum(F.col(f"w{i}") * (F.col(f"u{i}") - F.col("m"))).alias(f"h{i}") for i in k]).first()
    constants = np.log(counts / total) - 0.5 * np.array([half[f"h{i}"] for i in k])
    averages = solved.groupBy("v").agg(*[F.sum(F.col(f"w{i}") * F.col("m")).alias(f"a{i}") for i in k])  # a row per predictor
    weights = solved.join(F.broadcast(averages), "v").select(*KEY, *[(F.col(f"w{i}") - F.col(f"a{i}")).alias(f"w{i}") for i in k])
    plain = {variables[r["v"]]: r for r in solved.where(F.col("v").isin([variables.index(c) for c in numeric])).collect()} if numeric else {}
    numbers = {c: np.array([plain[c][f"w{i}"] / scale[c] for i in k]) for c in numeric}
    return LevelFit(label, classes, variables, counts, weights, constants, numbers, centre, taken[0])
