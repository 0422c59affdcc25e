"""The whole study end to end, written to files, and the readers."""

import os

import pytest
from pyspark.sql import functions as F

from basketlens.operators import conjoint, features
from basketlens.plans.product_design import product_map
from basketlens.plans.segmentation import SegmentationSettings, influence_review
from basketlens.plans.study import REPORT_TABLES, run_study, write_study
from basketlens.sources import readers, schemas, views
from basketlens import session

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_study_writes_every_table(spark, tmp_path):
    survey = conjoint.Survey(levels=views.RATING_LEVELS)
    market = views.profiles(views.ratings(spark, FOLDER)).withColumn("Description", F.col("Product"))
    proposed = market.orderBy("Product").first()["Product"]
    raw = views.raw_transactions(spark, FOLDER).withColumn("Work", F.length("Work"))
    people = views.prospects(spark, FOLDER).withColumn("Work", F.length("Work"))
    settings = SegmentationSettings(features.focus_category(views.FOCUS), starts=2, micro_clusters=20)
    tables = run_study(raw, people, views.ratings(spark, FOLDER), market, proposed, settings, survey)
    assert len(tables) == 33 and set(REPORT_TABLES) <= tables.keys()
    paths = write_study(tables, str(tmp_path / "out"))
    assert len(paths) == 33
    customers = spark.read.option("header", True).csv(f"{tmp_path}/out/customer_data_clustered")
    assert customers.count() == tables["customer_data_rfm"].count()
    assert {"KMeans_Cluster", "Hierarchical_Cluster", "Cluster_Label", "RFM_segment_seq"} <= set(customers.columns)
    shares = tables["conjoint_market_share_prediction"].agg(F.sum("Predicted_Market_Share")).first()[0]
    assert shares == pytest.approx(1.0)
    posterior = tables["prospect_targeting_lda_predictions"].select(
        sum(F.col(f"Cluster_Probability_{i}") for i in range(1, 5)).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert tuple(posterior) == pytest.approx((1.0, 1.0))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_product_map_and_influence(spark):
    products = views.products(spark, FOLDER)
    new = products.limit(1).withColumn("product_name", F.lit("new"))
    result = product_map(products, new, views.PRODUCT_VARIABLES)
    assert result.pve.agg(F.sum("PVE")).first()[0] == pytest.approx(1.0)
    assert result.scores.count() == products.count() and result.new_scores.first().product_name == "new"
    lines = views.raw_transactions(spark, FOLDER)
    from basketlens.operators.quality import clean_transactions
    review = influence_review(clean_transactions(lines).persist(), features.focus_category(views.FOCUS))
    assert review.where("Cooks_Distance is not null").count() > 0


def test_csv_reader_keeps_blank_text(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text(
        "InvoiceNo,CustomerID,InvoiceDate,ProductID,ProductCategory,UnitPrice,Quantity,Income,Extra\n"
        "1,C1,2025-01-02,P1,tea,2.50,3,NA,x\n2,C2,2025-01-03,P2,NA,1.00,1,10,y\n3,C3,2025-01-04,P3,\"\",1.00,1,,z\n")
    df = readers.read_transactions(spark, str(path))
    got = {r.CustomerID: r for r in df.collect()}
    assert got["C1"].Income is None and got["C2"].ProductCategory is None and got["C3"].ProductCategory == ""
    assert got["C3"].Income is None and "Extra" not in df.columns
    assert dict(df.dtypes)["UnitPrice"] == "decimal(12,2)" and dict(df.dtypes)["InvoiceDate"] == "date"


def test_product_reader_renames_misspelt_column(spark, tmp_path):
    path = tmp_path / "products.csv"
    header = [f.name for f in schemas.PRODUCTS.fields]
    path.write_text(",".join(header) + "\n" + ",".join(["A"] + ["1"] * (len(header) - 1)) + "\n")
    assert "sustainability_claim" in readers.read_products(spark, str(path)).columns


def test_written_keeps_rows(spark):
    df = session.written(spark.range(10).where("id > 3"))
    assert df.count() == 6
