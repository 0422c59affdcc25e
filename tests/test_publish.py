"""Result tables as one set, and duplicates by fingerprints."""

import os

import pytest
from pyspark.sql import functions as F

from basketlens.operators import quality
from basketlens.sources import writers


def test_a_failing_table_leaves_the_old_set(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert writers.published_tables(spark, folder) == {}
    tables = {f"t{i}": spark.range(i + 1) for i in range(3)}
    paths = writers.publish_tables(tables, folder, "parquet")
    assert list(writers.published_tables(spark, folder).values()) == paths
    bad = {"t0": spark.range(9), "t1": spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "t2": spark.range(9)}
    with pytest.raises(Exception, match="no"):
        writers.publish_tables(bad, folder, "parquet")
    now = writers.published_tables(spark, folder)
    assert [spark.read.parquet(now[f"t{i}"]).count() for i in range(3)] == [1, 2, 3]
    assert len([x for x in os.listdir(folder) if not x.startswith(".")]) == 2  # the manifest and one version
    for n in (5, 6):
        writers.publish_tables({"t0": spark.range(n)}, folder, "parquet")
    now = writers.published_tables(spark, folder)
    assert now.keys() == {"t0"} and spark.read.parquet(now["t0"]).count() == 6
    assert len([x for x in os.listdir(folder) if x.startswith("version-")]) == 2  # the set and the one before


def test_duplicates_by_fingerprints(spark, monkeypatch):
    rows = [(1, "a", None, 0.0), (1, "a", None, -0.0), (None, "a", "x", 1.0), (None, "x", "a", 1.0), (1, None, "a", float("nan")),
            (1, None, "a", float("nan")), (1, "a", None, 0.0), (2, "", None, None), (2, None, "", None)]
    df = spark.createDataFrame(rows, "k int, `a b` string, c string, d double")
    want = df.count() - df.distinct().count()
    assert want == 3 and quality.duplicate_count(df).first()[0] == want
    monkeypatch.setattr(quality, "row_fingerprint", lambda df: [F.lit(0), F.lit(0)])  # all collide
    assert quality.duplicate_count(df).first()[0] == want
    assert quality.duplicate_count(df.where("false")).first()[0] == 0
    monkeypatch.undo()
    plan = quality.duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
