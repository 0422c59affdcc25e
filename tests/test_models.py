"""Least squares, ANOVA, discriminants, components and clusters against numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from basketlens.functions import tails
from basketlens.operators import anova, clustering, discriminant, positioning, regression


def test_tails():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_upper(13.0, 2, 6) == pytest.approx((6 / (6 + 2 * 13.0)) ** 3, rel=1e-12)
    exact = sum(math.comb(20, k) * 0.55**k * 0.45 ** (20 - k) for k in range(15, 21))
    assert tails.binomial_upper(15, 20, 0.55) == pytest.approx(exact, rel=1e-12)
    for n in (10**6, 10**9, 10**11):  # closed forms: half and half the middle term; (df2 / (df2 + 2 f)) ^ (df2 / 2)
        middle = math.exp(-0.5 * math.log(math.pi * n / 2) - 1 / (4 * n))
        assert tails.binomial_upper(n // 2, n, 0.5) == pytest.approx(0.5 + middle / 2, rel=1e-9)
        assert tails.f_upper(3.0, 2, n) == pytest.approx(math.exp(-n / 2 * math.log1p(6.0 / n)), rel=1e-9)
        assert tails.t_two_sided(2.0, n) == pytest.approx(tails.f_upper(4.0, 1, n), rel=1e-9)
        assert tails.t_two_sided(1.959963984540054, n) == pytest.approx(0.05 + 0.2773 / n, rel=1e-9)
    assert tails.binomial_upper(0, 20, 0.5) == 1.0 and tails.f_upper(0.0, 2, 5) == 1.0


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) * [1.0, 1000.0] + [5.0, 20_000.0]
    y = 2.0 + x @ [1.5, -0.003] + rng.normal(size=60) * 0.1
    y[0] += 5.0
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y double")
    return df, x, y


def test_least_squares_and_cook(spark, linear):
    df, x, y = linear
    fit = regression.ols_fit(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [fit.intercept, *fit.slopes] == pytest.approx(beta, rel=1e-8)
    residual = y - design @ beta
    s2 = residual @ residual / (len(y) - 3)
    assert fit.sigma2 == pytest.approx(s2, rel=1e-8)
    inverse = np.linalg.inv(design.T @ design)
    table = {r.term: r for r in fit.coefficients(spark).collect()}
    assert table["a"].std_error == pytest.approx(math.sqrt(s2 * inverse[1, 1]), rel=1e-6)
    h = np.einsum("ij,jk,ik->i", design, inverse, design)
    cook = residual**2 / (3 * s2) * h / (1 - h) ** 2
    got = {r.id: r for r in regression.cooks_distance(df, fit).collect()}
    assert [got[i].Cooks_Distance for i in range(60)] == pytest.approx(cook, rel=1e-6)
    assert got[0].Influence_4_over_n
    mllib = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df))
    assert mllib.coefficients.toArray() == pytest.approx(fit.slopes, rel=1e-6)
    assert mllib.summary.pValues[:2] == pytest.approx([table["a"].p_value, table["b"].p_value], abs=1e-9)


def test_dependent_predictors_are_named(linear):
    df = linear[0].withColumn("c", F.col("a") * 2).withColumn("k", F.lit(1.0))
    with pytest.raises(ValueError, match="dependent"):
        regression.ols_fit(df, "y", ["a", "b", "c"])
    with pytest.raises(ValueError, match="constant columns: .*k"):
        regression.ols_fit(df, "y", ["a", "k"])


def test_anova(spark):
    data = [(g, float(v)) for g, vs in (("a", (1, 2, 3)), ("b", (2, 3, 4)), ("c", (5, 6, 7))) for v in vs]
    got = anova.anova_oneway(spark.createDataFrame(data, "g string, x double"), "g", ["x"]).first()
    assert got.F_Value == pytest.approx(13.0) and got.Eta_Squared == pytest.approx(0.8125)
    assert got.P_Value == pytest.approx((6 / 32) ** 3) and got.Significant_5pct == "Yes" and got.Significant_1pct == "Yes"


def test_lda_against_formula(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(6, 2)), rng.normal(size=(4, 2)) + [2, 1]])
    y = [1] * 6 + [2] * 4
    df = spark.createDataFrame([(i, c, float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))],
                               "CustomerID long, KMeans_Cluster int, u double, v double")
    fit = discriminant.lda_fit(df, "KMeans_Cluster", ["u", "v"])
    means = np.array([x[:6].mean(0), x[6:].mean(0)])
    centred = np.vstack([x[:6] - means[0], x[6:] - means[1]])
    inverse = np.linalg.inv(centred.T @ centred / 8)
    delta = x @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log([0.6, 0.4])
    posterior = np.exp(delta - delta.max(1, keepdims=True))
    posterior /= posterior.sum(1, keepdims=True)
    got = {r.CustomerID: r for r in fit.predict(df).collect()}
    for i in range(10):
        assert got[i].Cluster_Probability_1 == pytest.approx(posterior[i, 0], rel=1e-9)
        assert got[i].Predicted_Cluster == 1 + int(posterior[i, 1] > posterior[i, 0])
        assert got[i].Max_Cluster_Probability == pytest.approx(posterior[i].max())
    scaling = fit._discriminants()[0]
    assert scaling.T @ fit.pooled @ scaling == pytest.approx(np.eye(1), abs=1e-9)
    assert fit.trace_table(spark).first().Trace_Share == pytest.approx(1.0)


def test_lda_text_predictors_and_missing(spark):
    data = [(i, 1 + i % 2, float(i % 5), "xyz"[i % 3] if i else None) for i in range(60)]
    df = spark.createDataFrame(data, "CustomerID long, KMeans_Cluster int, n double, t string")
    fit = discriminant.lda_fit(df, "KMeans_Cluster", ["n", "t"])
    assert fit.names == ["n", "t_y", "t_z"] and fit.counts.sum() == 59
    missing = [r for r in fit.predict(df).collect() if r.CustomerID == 0][0]
    assert missing.Predicted_Cluster is None and missing.Max_Cluster_Probability is None


@pytest.mark.parametrize("slices", [None, 6])
def test_split_is_exact_per_class(spark, slices):
    df = spark.range(1_003).select(F.col("id").alias("CustomerID"), F.when(F.col("id") % 10 < 7, 1).otherwise(2).alias("c"))
    got = discriminant.stratified_split(df, "c", "CustomerID", 0.7, slices=slices).groupBy("c").agg(
        F.count_if("is_train").alias("train"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 1_003
    for r in got:
        assert r.train == math.ceil(0.7 * r.n)


def test_split_does_not_depend_on_slices(spark):
    df = spark.range(4_000).select(F.col("id").alias("CustomerID"), (F.col("id") % 3).alias("c"))
    key = F.col("CustomerID") % 11  # heavy ties on the key
    a = discriminant.stratified_split(df, "c", "CustomerID", key=key, slices=1)
    b = discriminant.stratified_split(df, "c", "CustomerID", key=key, slices=8)
    assert a.select("CustomerID", "is_train").exceptAll(b.select("CustomerID", "is_train")).count() == 0


def test_confusion_keeps_rows_without_a_listed_class(spark):
    predictions = spark.createDataFrame([(1, 1), (2, 1), (None, 2), (3, 2)], "Predicted_Cluster int, KMeans_Cluster int")
    cells = discriminant.confusion_matrix(predictions, [1, 2]).collect()
    assert sum(r.Customers for r in cells) == 4 and len(cells) == 6


def test_confusion_metrics(spark):
    # rows predicted: [[8, 2], [3, 7]]
    cells = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 1, 3), (2, 2, 7)],
                                  "Predicted_Cluster int, Actual_Cluster int, Customers long")
    overall = discriminant.overall_metrics(cells).first()
    assert (overall.Accuracy, overall.Kappa, overall.No_Information_Rate) == pytest.approx((0.75, 0.5, 0.55))
    exact = sum(math.comb(20, k) * 0.55**k * 0.45 ** (20 - k) for k in range(15, 21))
    assert overall.Accuracy_P_Value == pytest.approx(exact, rel=1e-9)
    one = {r.Cluster: r for r in discriminant.class_metrics(cells).collect()}[1]
    assert (one.Sensitivity, one.Specificity, one["Pos Pred Value"]) == (0.727, 0.778, 0.8)
    empty = discriminant.class_metrics(cells.where("Actual_Cluster = 1").withColumn("Customers", F.col("Customers") * 0))
    assert empty.count() >= 1


def test_pca_two_variables(spark):
    # correlation .6 gives shares .8 and .2
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    a = (a - a.mean()) / a.std()
    e = rng.normal(size=200)
    e = e - e.mean() - a * (a @ e) / (a @ a)
    b = 0.6 * a + 0.8 * e / e.std()
    df = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "product_name string, a double, b double")
    fit = positioning.pca_fit(df, ["a", "b"])
    pve = fit.pve(spark).collect()
    assert [r.PVE for r in pve] == pytest.approx([0.8, 0.2]) and pve[1].Cumulative_PVE == pytest.approx(1.0)
    assert pve[0].Singular_Value == pytest.approx(math.sqrt(1.6 * 199))
    assert abs(fit.loadings[0]) == pytest.approx([math.sqrt(0.5)] * 2)
    scores = positioning.product_scores(df, fit).toPandas()
    assert scores.PC1.var() == pytest.approx(1.6) and abs(scores.PC1.corr(scores.PC2)) < 1e-9


def test_pca_refuses_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="constant"):
        positioning.pca_fit(df, ["a", "b"])


def test_brands_and_zone(spark):
    df = spark.createDataFrame([("Costa Bold", 0.5, 0.0), ("my ILLY tin", 2.0, 0.0), ("7days", 0.5, 2.0)],
                               "product_name string, PC1 double, PC2 double")
    assert [r.Brand for r in positioning.brand_from_name(df).collect()] == ["Costa", "my", None]
    assert [r.Brand for r in positioning.brand_by_rules(df).collect()] == ["Costa", "illy", "Other"]
    assert [r.In_Zone for r in positioning.in_zone(df).collect()] == [True, False, False]


# ------------------------------------------------------------------ clusters


def _brute_ward(points):
    """Merge heights by trying every pair on explicit member lists."""
    groups = [[p] for p in points]
    heights = []
    while len(groups) > 1:
        def cost(pair):
            a, b = (np.array(groups[i]) for i in pair)
            return 2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(groups)), 2), key=cost)
        heights.append(math.sqrt(cost((i, j))))
        groups[i] += groups.pop(j)
    return heights


def test_ward_exact_on_few_points(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(25, 3)) + np.repeat([[0, 0, 0], [6, 0, 0], [0, 9, 0]], [9, 8, 8], axis=0), 3)
    df = spark.createDataFrame([(i, Vectors.dense(p.tolist())) for i, p in enumerate(points)], ["id", "scaled"])
    out, tree = clustering.ward_clusters(df, 3, micro=50)
    assert [h for *_, h in tree.merges] == pytest.approx(_brute_ward(points.tolist()))
    got = {r.id: r.Hierarchical_Cluster for r in out.collect()}
    assert [len({got[i] for i in block}) for block in (range(9), range(9, 17), range(17, 25))] == [1, 1, 1]
    approx, _ = clustering.ward_clusters(df, 3, micro=8)
    assert approx.count() == 25 and approx.select("Hierarchical_Cluster").distinct().count() == 3


def test_kmeans_ladder(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(120, 2)) + np.repeat([[0, 0], [8, 0], [0, 8], [8, 8]], 30, axis=0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "CustomerID long, a double, b double")
    scaled = clustering.keep(clustering.standardise(clustering.cluster_matrix(df, ["a", "b"])))
    total = clustering.total_sum_of_squares(scaled, 2)
    assert total == pytest.approx(2 * 119)
    ladder = clustering.restart_stability(scaled, 2, 4, (1, 3)).orderBy("Nstart").collect()
    assert ladder[0].Total_Within_SS >= ladder[1].Total_Within_SS
    assert all(r.Total_Within_SS + r.Between_SS == pytest.approx(r.Total_SS) for r in ladder)
    elbow = clustering.elbow(scaled, 2, (1, 2, 4), starts=2).orderBy("K").collect()
    assert elbow[0].WSS_Reduction is None and elbow[0].Total_Within_SS == pytest.approx(total)
    assert elbow[1].Percent_Reduction == pytest.approx((total - elbow[1].Total_Within_SS) / total)
    model, cost = clustering.kmeans_best_of(scaled, 4, 3)
    sizes = sorted(r.n for r in clustering.attach_clusters(scaled, model).groupBy("KMeans_Cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [30, 30, 30, 30] and cost == pytest.approx(min(r.Total_Within_SS for r in ladder), rel=1e-3)


def test_all_starts_share_their_passes(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(200, 2)) + np.repeat([[0, 0], [9, 0], [0, 9], [9, 9]], 50, axis=0)
    df = clustering.keep(spark.createDataFrame([(i, Vectors.dense(p.tolist())) for i, p in enumerate(points)], ["id", "scaled"]))
    fits = clustering.run_starts(df, [(4, s) for s in range(6)] + [(2, 9), (500, 1)])
    for fit in fits[:7]:
        label = ((points[:, None] - fit.centres[None]) ** 2).sum(2).argmin(1)
        assert fit.cost == pytest.approx(((points - fit.centres[label]) ** 2).sum())
        assert fit.centres == pytest.approx(np.array([points[label == c].mean(0) for c in range(len(fit.centres))]))
    assert fits[7].cost == pytest.approx(0.0, abs=1e-9) and len(fits[7].centres) == 200


def test_cluster_matrix_refuses_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(Exception):
        clustering.cluster_matrix(df, ["a", "b"]).collect()


def test_a_few_rows_far_off_are_found(spark):
    """One row in ten thousand lies far away: a start has to reach them."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(40_000, 2)), rng.normal(size=(4, 2)) + [500.0, 500.0]])
    df = spark.createDataFrame([(Vectors.dense(p.tolist()),) for p in points], ["scaled"]).repartition(5)
    found = clustering.candidates(clustering._points(df), 3)
    assert (found.rows.min(axis=1) > 400).any() and found.weights.sum() == len(points) and len(found.rows) < 1_500
    fit, _ = clustering.kmeans_best_of(df, 2, 1)
    assert sorted(fit.sizes) == [4, 40_000]


def test_many_equal_rows_do_not_hide_the_rest(spark):
    points = [(0.0, 0.0)] * 3_000 + [(float(i % 7), 9.0) for i in range(70)]
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["scaled"]).repartition(4)
    found = clustering.candidates(clustering._points(df), 8)
    assert len(found.rows) == 8 and sorted(found.weights) == [10] * 7 + [3_000]
    fits = clustering.run_starts(df, [(8, 1), (20, 2)])
    assert [f.cost for f in fits] == pytest.approx([0.0, 0.0], abs=1e-18)


def test_equal_starts_go_on_as_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(200, 2)) + np.repeat([[0, 0], [9, 0], [0, 9], [9, 9]], 50, axis=0)
    df = clustering.keep(spark.createDataFrame([(Vectors.dense(p.tolist()),) for p in points], ["scaled"]))
    seen, plain = [], clustering._assign_all
    monkeypatch.setattr(clustering, "_assign_all", lambda p, s: seen.append(len(s)) or plain(p, s))
    fits = clustering.run_starts(df, [(4, s) for s in range(12)])
    assert len(fits) == 12 and len({round(f.cost, 6) for f in fits}) <= 4 and max(seen[2:]) < 12 and len(seen) < 60


def test_nearest_neighbour_chain_equals_brute_force():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 3))
    tree = clustering.ward_merges(points, np.ones(40))
    assert [h for *_, h in tree.merges] == pytest.approx(_brute_ward(points.tolist()))
    assert sum(h * h for *_, h in tree.merges) / 2 == pytest.approx(((points - points.mean(0)) ** 2).sum())
    grid = np.array([[x, y] for x in range(4) for y in range(4)], float)  # many ties
    merges = clustering.ward_merges(grid, np.ones(16)).merges
    assert len(merges) == 15 and sum(h * h for *_, h in merges) / 2 == pytest.approx(((grid - grid.mean(0)) ** 2).sum())
    seen = set()
    for step, (a, b, _) in enumerate(merges):
        assert a < 16 + step and b < 16 + step and not {a, b} & seen
        seen |= {a, b}


def test_ward_on_five_thousand_rows(spark):
    """The last merges of the micro-cluster tree against those of the tree of all rows; the rest is bounded by what is inside."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(5_000, 3)) + 6 * rng.normal(size=(12, 3))[rng.integers(0, 12, 5_000)]
    df = clustering.keep(spark.createDataFrame([(i, Vectors.dense(p.tolist())) for i, p in enumerate(points)], ["id", "scaled"]).repartition(6))
    exact = clustering.ward_merges(points, np.ones(len(points)))
    out, tree = clustering.ward_clusters(df, 6, micro=600)
    total = ((points - points.mean(0)) ** 2).sum()
    assert len(tree.sizes) <= 600 and tree.sizes.sum() == 5_000 and tree.radius > 0
    assert sum(h * h for *_, h in tree.merges) / 2 + tree.inside == pytest.approx(total)
    assert tree.inside < 0.05 * total
    ours, theirs = (np.array([h for *_, h in t.merges[-6:]]) for t in (tree, exact))
    assert np.abs(ours**2 - theirs**2).max() / 2 <= tree.inside
    assert np.allclose(ours, theirs, rtol=0.1)
    assert out.groupBy("Hierarchical_Cluster").count().count() == 6
    whole, same = clustering.ward_clusters(df, 6, micro=5_000)
    assert same.radius == 0 and same.inside == pytest.approx(0.0, abs=1e-6)
    assert [h for *_, h in same.merges[-20:]] == pytest.approx([h for *_, h in exact.merges[-20:]])
