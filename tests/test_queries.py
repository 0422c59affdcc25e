"""Every registered query on the smallest tables: SQL agreement, and invariants where there is no SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_sql_names_are_queries():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "Customers" in df.columns


def test_crosstabs_cover_every_customer(spark):
    n = QUERIES["customer_features"](spark, FOLDER).count()
    for name, key in (("rfm_segment_crosstab", "RFM_segment_ind"), ("kmeans_ward_crosstab", "KMeans_Cluster")):
        df = QUERIES[name](spark, FOLDER)
        assert sum(v for r in df.collect() for k, v in r.asDict().items() if k != key) == n


def test_segments_at_the_documented_scale(spark):
    """Figures worked out by hand for the 60,000-line tables."""
    folder = "/root/testdata/sf0.01"
    got = {r["RFM_segment_ind"]: r for r in QUERIES["rfm_independent_segment_summary"](spark, folder).collect()}
    assert got["Champions"]["Customers"] == 252 and got["Champions"]["Total_Monetary"] == 336501466.50
    assert got["Low-value inactive"]["Focus_Buyers"] == 100 and got["Promising"]["Median_Monetary"] == 1224204.85
    assert got["At-risk high-value"]["Avg_Frequency"] == pytest.approx(12.9259, abs=1e-4)
    assert sum(r["Customers"] for r in got.values()) == 1500
    assert QUERIES["clean_transactions"](spark, folder).count() == 58_781
