"""Exact quantiles and n-tiles against numpy and plain windows, with the order cut into slices."""

import math

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.operators import rank as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold well over a third of the rows."""
    return spark.range(30_000).select(
        "id",
        F.when(F.col("id") % 5 < 2, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.rand(3) < 0.4, 1).otherwise((F.rand(1) * 20).cast("int")).alias("f"),
        F.exp(F.randn(5) * 2).alias("m"),
    ).persist()


@pytest.mark.parametrize("bits", [22, 11])
def test_quantiles_match_numpy(skewed, bits):
    got = R.exact_quantiles(skewed, ["f", "m"], [0.0, 0.01, 0.5, 0.99, 0.999, 1.0], ["g"], bits).collect()
    data = skewed.toPandas()
    assert len(got) == data.g.nunique() * 2 * 6
    for r in got:
        expected = np.quantile(data[data.g == r.g][r.Variable], r.p)
        assert r.value == pytest.approx(expected, rel=1e-12)


def test_order_bits_are_those_of_the_format(spark):
    numbers = np.concatenate([
        [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 1.7976931348623157e308, np.inf],
        2.0 ** np.arange(-1022, 1024, 7), np.nextafter(2.0 ** np.arange(-1021, 1024, 7), 0),
        np.random.default_rng(3).integers(1, 2047 << 52, 5_000).view(np.float64),
    ])
    numbers = np.concatenate([numbers, -numbers])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(numbers)], "i int, x double")
    got = df.select("i", R.order_bits(F.col("x")).alias("k")).select("i", "k", R.from_order_bits(F.col("k")).alias("x"))
    for r in got.collect():
        x = numbers[r.i]
        assert r.k == int(np.abs(x).view(np.int64)) * (-1 if x < 0 else 1) and r.x == x


def test_a_quantile_neither_sorts_nor_moves_its_rows(skewed, capsys):
    R.exact_quantiles(skewed, ["m"], [0.5], ["g"]).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_quantiles_of_numbers_that_share_all_leading_bits(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0).alias("s"), (1.0 + F.col("id") * 2.0**-52).alias("x"))
    df = df.select("s", (F.col("s") * F.col("x")).alias("x"))
    data = df.toPandas()
    for r in R.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.7513], ["s"]).collect():
        assert r.value == pytest.approx(np.quantile(data[data.s == r.s].x, r.p), rel=4e-16)
    assert R.exact_quantiles(df.withColumn("s", F.lit(None).cast("string")), ["x"], [1.0], ["s"]).collect()[0].value == data.x.max()


def test_no_slice_holds_a_hot_group(skewed):
    ranked = R.running(skewed.select("g", "m", "id"), ["g"], ["m", "id"], F.lit(1), 9)
    sizes = skewed.groupBy("g").count().collect()
    assert {r.g: r.n for r in ranked.groupBy("g").agg(F.max("cum").alias("n")).collect()} == {r["g"]: r["count"] for r in sizes}
    assert ranked.select("g", "cum").distinct().count() == skewed.count()


def test_quantiles_ignore_missing_and_keep_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (3.0,)], "x double")
    got = {r.p: r.value for r in R.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 3.0, 1.0: float("inf")}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert [r.value for r in R.exact_quantiles(df, ["x"], [0.5]).collect()] == [None]
    assert R.quantile_columns(df.where("false"), {"q": ("x", 0.5)}).collect()[0].q is None


SPECS = [
    R.NTile("r", "f", descending=True), R.NTile("m5", "m"),
    R.NTile("fr", "f", by=("r",)), R.NTile("mr", "m", by=("r", "fr")),
]


@pytest.mark.parametrize("slices", [None, 7])
def test_ntiles_are_those_of_a_window(skewed, slices):
    names = ["id", *[s.out for s in SPECS]]
    plain = skewed
    for s in SPECS:
        order = F.col(s.value).desc() if s.descending else F.col(s.value)
        plain = plain.withColumn(s.out, F.ntile(s.buckets).over(W.partitionBy(*s.by).orderBy(order, "id")))
    got = R.add_ntiles(skewed, SPECS, "id", slices).select(*names)
    assert plain.select(*names).exceptAll(got).count() == 0
    assert got.count() == skewed.count()


def test_ntile_text_keys(spark):
    df = spark.range(5_000).select(F.concat(F.lit("C"), F.lpad("id", 6, "0")).alias("id"), F.lit(1).alias("f"))
    got = R.add_ntiles(df, [R.NTile("s", "f")], "id", 5)
    plain = df.withColumn("s", F.ntile(5).over(W.orderBy("f", "id")))
    assert plain.select("id", "s").exceptAll(got.select("id", "s")).count() == 0


def test_ntile_sizes_and_tie_order(spark):
    # eleven customers, seven with equal frequency: sizes 3,2,2,2,2, ties in key order
    data = [(i, 1 if i < 7 else i) for i in range(11)]
    df = spark.createDataFrame(data, "id long, f int")
    got = {r.id: r.s for r in R.add_ntiles(df, [R.NTile("s", "f")], "id", 3).collect()}
    assert [got[i] for i in range(11)] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_ntile_fewer_rows_than_buckets_and_nulls(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id long, f int")
    got = {r.id: r.s for r in R.add_ntiles(df, [R.NTile("s", "f")], "id").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: None}


def test_lowest_share_splits_ties_by_key(spark):
    df = spark.range(1_000).select("id", (F.col("id") % 3).alias("c"), F.lit(5).alias("k"))
    got = R.lowest_share(df, "c", ["k", "id"], 0.7, "low", 4)
    for c in range(3):
        ids = sorted(r.id for r in got.where(f"c = {c} and low").collect())
        own = [i for i in range(1_000) if i % 3 == c]
        assert ids == own[: math.ceil(0.7 * len(own))]


def test_order_bits_in_steps_are_the_same(spark):
    numbers = np.concatenate([
        [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, np.inf, np.nan],
        2.0 ** np.arange(-1022, 1024, 3), np.nextafter(2.0 ** np.arange(-1021, 1024, 3), 0),
        np.random.default_rng(4).integers(1, 2047 << 52, 2_000).view(np.float64),
    ])
    numbers = [None, *map(float, np.concatenate([numbers, -numbers]))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    both = R.with_order_bits(df.withColumn("k", F.col("x")), "k").withColumn("old", R.order_bits(F.col("x")))
    assert both.where("not (k <=> old)").count() == 0 and both.count() == len(numbers)


def test_small_groups_and_few_values_take_one_pass(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(R, "written", lambda df, keep=R.written: tables.append(df.columns) or keep(df))
    df = spark.range(3_000).select((F.col("id") % 1_000).alias("g"), (F.col("id") * 0.37).alias("x"), (F.col("id") % 50).alias("f"))
    got = {r.g: (r.x, r.f) for r in R.quantile_columns(df, {"x": ("x", 0.5), "f": ("f", 0.9)}, ["g"]).collect()}
    assert len(tables) == 2  # the values, then one pass
    data = df.toPandas().groupby("g")
    x, f = data.x.median(), data.f.quantile(0.9)
    assert all(got[g] == (pytest.approx(x[g]), pytest.approx(f[g])) for g in range(1_000))
