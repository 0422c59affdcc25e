"""Discriminants whose levels are rows: against the dense fit, and against the normal equations with many levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import discriminant
from basketlens.operators.levels import lda_fit_levels


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(8)
    n = 1_500
    town, work = rng.choice(12, n, p=[0.4, *[0.6 / 11] * 11]), rng.integers(0, 4, n)
    cls = (rng.normal(size=n) + town * 0.1 + work * 0.3).round().clip(0, 2).astype(int)
    age = 40 + 5 * cls + rng.normal(size=n) * 9
    rows = [(i, int(c), f"town{t}", f"work.{w}", float(a), 1e9 + float(a * 3 + rng.normal())) for i, (c, t, w, a) in enumerate(zip(cls, town, work, age))]
    return spark.createDataFrame(rows, "id long, c int, town string, `work place` string, age double, far double").persist()


def test_levels_agree_with_the_dense_fit(people):
    names = ["age", "town", "work place", "far"]
    fit = lda_fit_levels(people, "c", names)
    plain = people.withColumnRenamed("work place", "work")
    scaler = discriminant.fit_scaler(plain, ["age", "far"])
    dense = discriminant.lda_fit(scaler.apply(plain), "c", ["age", "town", "work", "far"])
    got = {r.id: r for r in fit.predict(people).collect()}
    assert fit.steps < 60 and len(got) == 1_500 and fit.classes == [0, 1, 2]
    for r in dense.predict(scaler.apply(plain)).collect():
        assert got[r.id].Predicted_Cluster == r.Predicted_Cluster
        for k in range(3):
            assert got[r.id][f"Cluster_Probability_{k}"] == pytest.approx(r[f"Cluster_Probability_{k}"], rel=1e-6, abs=1e-12)


def test_missing_and_unseen_levels(spark, people):
    fit = lda_fit_levels(people.withColumn("town", F.when(F.col("id") != 3, F.col("town"))), "c", ["town", "work place"])
    assert fit.counts.sum() == 1_499
    probe = spark.createDataFrame([(1, None, "work.1"), (2, "nowhere", "work.1"), (3, "nowhere", "nothing")], "id long, town string, `work place` string")
    got = {r.id: r for r in fit.predict(probe).collect()}
    assert got[1].Predicted_Cluster is None and got[1].Cluster_Probability_0 is None
    assert got[2].Predicted_Cluster is not None and sum(got[3][f"Cluster_Probability_{k}"] for k in range(3)) == pytest.approx(1)
    assert got[2].asDict().keys() == {"id", "town", "work place", "Predicted_Cluster", "Max_Cluster_Probability", *[f"Cluster_Probability_{k}" for k in range(3)]}


def test_fifty_thousand_levels_solve_the_normal_equations(spark):
    size = 50_000
    df = spark.range(200_000).select(F.concat(F.lit("z"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % size)).alias("zip"), (F.col("id") % 7 % 2).alias("c"))
    fit = lda_fit_levels(df, "c", ["zip"])
    data = df.groupBy("zip").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (0, 1)]).toPandas().set_index("zip")
    w = fit.weights.toPandas().set_index("level").loc[data.index]
    counts = data[["n0", "n1"]].to_numpy(float)
    means, n = counts / counts.sum(0), counts.sum()
    for k in (0, 1):
        v = w[f"w{k}"].to_numpy()
        turned = (counts.sum(1) * v - means @ (counts.sum(0) * (means.T @ v))) / (n - 2)
        assert np.abs(turned - (means[:, k] - counts.sum(1) / n)).max() < 1e-9 * means.max()
    assert len(w) > 30_000


def test_what_cannot_be_told_apart_inside_classes_is_refused(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("c"), F.concat(F.lit("l"), F.col("id") % 2).alias("t"))
    with pytest.raises(ValueError):
        lda_fit_levels(df, "c", ["t"])
    with pytest.raises(ValueError, match="two classes"):
        lda_fit_levels(df.where("c = 0"), "c", ["t"])
    with pytest.raises(ValueError, match="two classes"):
        lda_fit_levels(df.where("false"), "c", ["t"])
