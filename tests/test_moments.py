"""Sums of products against numpy, far from zero; lifetime of tables written on the way."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.functions import moments
from basketlens.session import settled, shared_folder, temporary, written


def _tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(folder) if x.startswith("table-")} if os.path.isdir(folder) else set()


def _frame(spark, far):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) @ np.array([[1.0, 0.4], [0.0, 0.8]])
    level = rng.integers(0, 3, 400)
    group = np.where(rng.random(400) < 0.6, "hot", np.array(list("abc"))[rng.integers(0, 3, 400)])
    shift = {"hot": far, "a": -far, "b": 0.0, "c": far / 3}
    x = x + np.array([[shift[g], -2 * shift[g]] for g in group])
    rows = [(str(g), float(a), float(b), float(k == 1), float(k == 2)) for g, (a, b), k in zip(group, x, level)]
    data = np.array([r[1:] for r in rows])
    return spark.createDataFrame(rows, "g string, u double, v double, d1 double, d2 double"), group, data


def _exact(data):
    x = data.astype(np.longdouble)
    centred = x - x.mean(0)
    return (centred.T @ centred / (len(x) - 1)).astype(float)


@pytest.mark.parametrize("far", [0.0, 1e9])
def test_grouped_moments_far_from_zero(spark, far):
    df, group, data = _frame(spark, far)
    names = ["u", "v", "d1", "d2"]
    for rows in (
        moments.group_moments(df, "g", names, indicators=[["d1", "d2"]]).collect(),
        moments.group_moments(df, "g", names, few=True).collect(),
    ):
        assert {r.g for r in rows} == {"hot", "a", "b", "c"}
        for r in rows:
            own = data[group == r.g]
            assert r.n == len(own) and r.mean == pytest.approx(own.mean(0), rel=1e-12, abs=1e-9)
            got = moments.unpack_symmetric(r["cov"], 4)
            assert np.allclose(got, _exact(own), rtol=1e-6, atol=1e-7)


def test_pooled_moments_at_a_mean_of_a_billion(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(500, 3)) + [1e9, -1e9, 5.0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double").repartition(7)
    before = _tables(spark)
    m = moments.collect_moments(df.union(spark.createDataFrame([(None, 1.0, 1.0)], df.schema)), ["a", "b", "c"])
    assert m.n == 500 and np.allclose(m.cov, _exact(data), rtol=1e-6, atol=1e-8) and np.allclose(m.mean, data.mean(0), rtol=1e-14)
    assert _tables(spark) == before


def test_groups_of_one_row_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 3.0, 4.0), (None, 5.0, 9.0)], "g string, u double, v double")
    got = {r.g: r for r in moments.group_moments(df, "g", ["u", "v"]).collect()}
    assert got["a"].n == 1 and got["a"]["cov"] == [None, None, None]
    assert got[None].n == 2 and got[None]["cov"] == pytest.approx([2.0, 5.0, 12.5])
    assert moments.group_moments(df.where("false"), "g", ["u", "v"]).count() == 0


def test_tables_go_with_their_block(spark):
    before = _tables(spark)
    with pytest.raises(RuntimeError, match="stop"), temporary(spark):
        assert written(spark.range(5)).count() == 5 and len(_tables(spark) - before) == 1
        with pytest.raises(Exception):  # a write that fails leaves nothing either
            written(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")))
        raise RuntimeError("stop")
    assert _tables(spark) == before
    kept = settled(spark, lambda: written(written(spark.range(3)).selectExpr("id * 2 AS id")))
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4] and len(_tables(spark) - before) == 1
    with temporary(spark):
        assert settled(spark, lambda: written(spark.range(2))).count() == 2
    assert len(_tables(spark) - before) == 1
