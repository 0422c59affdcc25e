"""Cleaning, quality, outliers and features on hand-made lines."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketlens.operators import charts, features, outliers, quality
from basketlens.sources import schemas

D = dt.date


@pytest.fixture(scope="module")
def raw(spark):
    def line(customer, invoice, date, product, category, price, quantity, income=1.0):
        return (customer, invoice, date, product, category, Decimal(price), quantity, 1, 2, income, 30, "z", 0, 1)

    data = [
        line("C1", 1, D(2025, 1, 1), "P1", "tea", "2.00", 3),
        line("C1", 1, D(2025, 1, 1), "P1", "tea", "2.00", 3),       # exact copy
        line("C1", 1, D(2025, 1, 1), "P2", "milk", "1.50", 2),
        line("C1", 2, D(2025, 1, 5), "P1", "tea", "2.00", 1),
        line("C2", 3, D(2025, 1, 2), "P2", "milk", "1.50", 4),
        line("C2", 4, D(2025, 1, 9), "P3", None, "9.00", 1),        # no category
        line("C2", 4, D(2025, 1, 9), "P3", "", "9.00", 1),          # blank category
        line("C3", 5, D(2025, 1, 3), "P2", "milk", "1.50", 0),      # nothing bought
        line("C3", 6, D(2025, 1, 4), "P1", "tea", "2.00", 1930),    # extreme line
        line("C4", 7, D(2025, 1, 10), "P2", "milk", "1.50", 1, None),
        line("C4", 8, D(2025, 1, 10), "P4", "eggs", "3.00", 2, 7.0),
        line("C4", 8, D(2025, 1, 10), "P1", "tea", "2.00", 1, 8.0),
    ]
    return spark.createDataFrame(data, schemas.TRANSACTIONS)


@pytest.fixture(scope="module")
def lines(raw):
    return quality.clean_transactions(raw, blank_is_missing=True).persist()


def joins(line, part, order):
    return line.join(part, "ProductID").join(order, "InvoiceNo").select(
        "CustomerID", "InvoiceNo", "InvoiceDate", "ProductID", "ProductCategory", "UnitPrice", "Quantity")


def test_clean_of_joined_tables(spark, rows):
    """Repeated, null and unmatched keys in every table; wide rows are not grouped."""
    line = spark.createDataFrame(
        [(1, 1, 3), (1, 1, 3), (1, 1, 4), (1, 2, 1), (2, 1, None), (2, 1, None), (2, 3, 1), (None, 1, 1), (9, 1, 1), (3, 4, 2)],
        "InvoiceNo long, ProductID long, Quantity int")
    price = Decimal("2.00")
    part = spark.createDataFrame(
        [(1, "tea", price), (1, "tea", price), (1, "milk", price), (1, None, price), (2, " ", None), (3, None, price), (4, "eggs", price),
         (None, "tea", price)], "ProductID long, ProductCategory string, UnitPrice decimal(12,2)")
    order = spark.createDataFrame(
        [(1, "a", D(2025, 1, 1)), (1, "a", D(2025, 1, 1)), (1, "b", D(2025, 1, 1)), (2, None, None), (3, "c", D(2025, 1, 2)), (None, "a", None)],
        "InvoiceNo long, CustomerID string, InvoiceDate date")
    for blank in (False, True):
        got = quality.clean_transactions(line, blank, lookups=[part, order], join=joins)
        expected = quality.clean_transactions(joins(line, part, order), blank)
        assert got.schema == expected.schema and got.count() == (11 if blank else 13)
        assert sorted(map(str, rows(got))) == sorted(map(str, rows(expected)))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    top = min(i for i, x in enumerate(plan) if "Join" in x)
    assert not any("Aggregate" in x for x in plan[:top])


def test_registered_lines_group_no_joined_rows(spark):
    from basketlens.registry import base

    plan = base.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in x for x in plan[:min(i for i, x in enumerate(plan) if "Join" in x)])


def extreme():
    return (F.col("CustomerID") == "C3") & (F.col("Quantity") == 1930)


def test_profiles(raw, rows):
    missing = {r["Variable"]: r["Missing_Count"] for r in rows(quality.missing_profile(raw))}
    assert missing["ProductCategory"] == 1 and missing["Income"] == 1 and missing["CustomerID"] == 0
    blank = {r["Variable"]: r["Missing_Count"] for r in rows(quality.missing_profile(raw, blank_is_missing=True))}
    assert blank["ProductCategory"] == 2
    assert rows(quality.duplicate_count(raw)) == [{"n_duplicates": 1}]
    card = rows(quality.cardinality_profile(raw, {"customers": "CustomerID", "categories": "ProductCategory"}))[0]
    assert card == {"rows": 12, "customers": 4, "categories": 5}  # null and blank count as values
    assert rows(quality.value_counts(raw, "ProductCategory"))[0]["n"] == 5


def test_nan_counts_as_missing(spark, rows):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert rows(quality.missing_profile(df))[0]["Missing_Count"] == 1


def test_clean(raw, lines, rows):
    assert lines.count() == 9
    assert quality.clean_transactions(raw).count() == 10  # a blank category is kept by default
    assert rows(quality.nonpositive_profile(lines))[0] == {
        "zero_or_negative_price": 0, "zero_or_negative_quantity": 1, "zero_or_negative_spend": 1}
    assert dict(lines.dtypes)["TotalSpend"] == "decimal(18,2)"


def test_exclusion_is_three_valued(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (2, 5)], "a int, b int")
    assert [r.a for r in quality.exclude_rows(df, (F.col("a") == 1) & (F.col("b") == 1)).collect()] == [2]


def test_cleaning_summary(lines, rows):
    got = rows(quality.cleaning_summary(lines, extreme(), features.focus_category("tea")))[0]
    assert (got["Rows_Before"], got["Rows_After"], got["Rows_Removed"]) == (9, 8, 1)
    assert got["Sales_Removed"] == Decimal("3860.00") and got["Focus_Spend_Removed"] == Decimal("3860.00")
    assert (got["Customers_Before"], got["Customers_After"]) == (4, 4)


def test_category_rank(lines, rows):
    ranked = {r["ProductCategory"]: r["CategoryRank"] for r in rows(quality.category_sales(lines))}
    assert ranked == {"tea": 1, "milk": 2, "eggs": 3}
    assert rows(quality.category_position(lines, "milk"))[0]["CategoryRank"] == 2


def test_customer_features(lines, rows):
    got = {r["CustomerID"]: r for r in rows(features.customer_features(lines, features.focus_category("tea")))}
    one = got["C1"]
    assert (one["Recency"], one["Frequency"], one["Monetary"]) == (6, 2, Decimal("11.00"))
    assert (one["CategoryDiversity"], one["ProductDiversity"], one["FocusInvoices"]) == (2, 2, 2)
    assert one["FocusSpend"] == Decimal("8.00") and one["FocusShare"] == pytest.approx(8 / 11)
    assert one["AvgBasketValue"] == pytest.approx(5.5)
    assert got["C4"]["Recency"] == 1 and got["C2"]["FocusBuyer"] == 0 and got["C2"]["FocusShare"] == 0.0


def test_features_form_lines_once(spark, rows):
    """Whatever is measured, each line is formed a single time; customers without a key keep their first line."""
    formed = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        formed.add(1)
        return x

    data = [(c, i, D(2025, 1, i), f"p{p}", f"g{p % 2}", p, Decimal(p), i * 10 + p) for c in ("a", "b", None) for i in (2, 1) for p in (3, 1, 2)]
    lines = spark.createDataFrame(
        data, "CustomerID string, InvoiceNo long, InvoiceDate date, ProductID string, ProductCategory string, Quantity int, "
        "TotalSpend decimal(18,2), Age int").withColumn("Quantity", counted("Quantity"))
    got = {r["CustomerID"]: r for r in rows(features.customer_features(lines, features.focus_category("g0"), ["Age"]))}
    assert formed.value == len(data)
    for customer, varied in (("a", (2, 3)), ("b", (2, 3)), (None, (None, None))):
        r = got[customer]
        assert (r["Frequency"], r["Monetary"], r["TotalQuantity"], r["FocusSpend"], r["FocusInvoices"]) == (2, 12, 12, 4, 2)
        assert (r["CategoryDiversity"], r["ProductDiversity"]) == varied and r["Age"] == 11 and r["Recency"] == 1


def test_first_line_wins_even_when_null(lines, rows):
    got = {r["CustomerID"]: r["Income"] for r in rows(features.first_row_values(lines, ["Income"]))}
    assert got["C4"] is None and got["C1"] == 1.0
    varying = {r["Variable"]: r["Customers"] for r in rows(features.varying_demographics(lines, ["Income", "Age"]))}
    assert varying == {"Income": 1, "Age": 0}


def test_outliers_and_sensitivity(lines, rows):
    flagged = outliers.flag_outliers(lines)
    assert [r["Quantity"] for r in rows(flagged)] == [1930]
    summary = rows(outliers.outlier_summary(flagged, lines))[0]
    assert summary["Outlier_Rows"] == 1 and summary["Share_of_Total_Sales"] == pytest.approx(3860 / 3886.5)
    versions = {r["Version"]: r for r in rows(outliers.sensitivity_summary(lines, extreme(), features.focus_category("tea")))}
    assert versions["With"]["Max_Monetary"] == Decimal("3860.00")
    assert versions["Without"]["Total_Sales"] == Decimal("26.50")
    assert versions["Without"]["Median_Focus_Spend_Buyers"] == pytest.approx(5.0)


def test_trim_and_cap(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    assert outliers.trim_percentile(df, "x", 0.01, 0.99).count() == 98
    assert outliers.cap_at_percentile(df, "x", 0.95).count() == 95


def test_histograms(spark, rows):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (10.0,), (17.0,)], "x double")
    fixed = {r["x_min"]: r["n"] for r in rows(charts.fixed_width_histogram(df, "x", 5.0, boundary=0.0))}
    assert fixed == {0.0: 2, 5.0: 2, 15.0: 1}  # right-closed, the lowest edge joins the first bin
    centred = {r["x_min"]: r["n"] for r in rows(charts.fixed_width_histogram(df, "x", 10.0))}
    assert centred == {-5.0: 2, 5.0: 2, 15.0: 1}
    bins = rows(charts.fixed_count_histogram(df, "x", 18))
    assert len(bins) == 18 and sum(b["n"] for b in bins) == 5 and bins[0]["n"] == 1 and bins[-1]["n"] == 1
    constant = rows(charts.fixed_count_histogram(df.select((F.col("x") * 0).alias("x")), "x", 4))
    assert sum(b["n"] for b in constant) == 5


def test_distinct_counts_in_one_scan(spark, capsys):
    rows = [(i % 5 or None, f"t{i % 7}", None if i % 3 else float(i), i % 2 == 0) for i in range(1_000)]
    df = spark.createDataFrame(rows, "a int, `b.c` string, d double, `__set2` boolean")
    wanted = {"A": "a", "B": "b.c", "D": "d", "again": "a", "E": "__set2"}
    assert quality.distinct_counts(df, wanted).first().asDict() == {"A": 4, "B": 7, "D": 334, "again": 4, "E": 2}
    assert quality.distinct_counts(df, wanted, nulls=True).first().asDict() == {"A": 5, "B": 7, "D": 335, "again": 5, "E": 2}
    assert quality.distinct_counts(df.where("false"), {"A": "a", "D": "d"}, nulls=True).first().asDict() == {"A": 0, "D": 0}
    assert quality.distinct_counts(df, {"A": "a"}, nulls=True).first().A == 5
    quality.distinct_counts(spark.range(10).selectExpr("id AS a", "id AS d"), {"A": "a", "D": "d"}).explain()
    assert capsys.readouterr().out.count("Range (") == 1
