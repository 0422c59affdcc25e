"""CSV folders: every file by its own header, and no value lost in silence."""

import datetime

import pytest

from basketlens.sources import readers, schemas
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "respondent_id,productNo,price,format,strength,origin,sustainability,rating"


def _write(folder, **files):
    folder.mkdir(parents=True)
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_files_with_different_column_orders(spark, tmp_path):
    swapped = HEADER.replace("price", "?").replace("rating", "price").replace("?", "rating")
    path = _write(tmp_path / "a", one=[HEADER, "r1,1,5,Instant,Mild,x,No,7"], two=[swapped, "r2,2,7,Ground,Dark,y,Yes,5"],
                  three=["extra," + HEADER, 'e,r3,3,"6",Capsule,NA,"",No,'])
    assert sorted(len(v) for v in readers.csv_layouts(spark, path).values()) == [1, 1, 1]
    got = {r.respondent_id: r for r in readers.read_ratings(spark, path).collect()}
    assert (got["r1"].price, got["r1"].rating) == (5.0, 7.0) and (got["r2"].price, got["r2"].rating) == (5.0, 7.0)
    assert got["r3"].price == 6.0 and got["r3"].rating is None and got["r3"].strength is None and got["r3"].origin == ""


def test_bad_rows_fail_or_are_kept_apart(spark, tmp_path):
    path = _write(tmp_path / "a", one=[HEADER, "r1,1,5,Instant,Mild,x,No,7", "r2,2,x4,Ground,Dark,y,Yes,5", "r3,3,4,Ground,Dark,y,Yes,5,9"],
                  two=[HEADER, "r4,99999999999,4,Ground,Dark,y,Yes,5", "r5,5,4,Ground", "r6,6,,Ground,Dark,y,Yes,NA"])
    with pytest.raises(Exception, match="price is not double: x4|not 8 cells|productNo is not int"):
        readers.read_ratings(spark, path).collect()
    good = readers.read_csv(spark, path, schemas.RATINGS, quarantine=str(tmp_path / "bad"))
    rows = {r.respondent_id: r for r in good.collect()}
    assert rows.keys() == {"r1", "r6"} and rows["r6"].price is None and rows["r6"].rating is None
    bad = {r.record.split(",")[0]: r for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad.keys() == {"r2", "r3", "r4", "r5"}
    assert bad["r2"].problem == "price is not double: x4" and bad["r2"].file.endswith("one.csv")
    assert bad["r3"].problem == bad["r5"].problem == "not 8 cells" and bad["r4"].problem == "productNo is not int: 99999999999"
    assert good.count() == 2


def test_types_and_no_files(spark, tmp_path):
    schema = T.StructType([T.StructField("d", T.DateType()), T.StructField("m", T.DecimalType(12, 2)), T.StructField("t", T.StringType())])
    path = _write(tmp_path / "a", one=["t,m,d", "a b,1.50,2024-02-29", "NA,NA,NA", '"x, ""y""",,'])
    got = readers.read_csv(spark, path, schema)
    assert got.dtypes == [("d", "date"), ("m", "decimal(12,2)"), ("t", "string")]
    assert sorted((r.t or "", str(r.m), r.d) for r in got.collect()) == [
        ("", "None", None), ("a b", "1.50", datetime.date(2024, 2, 29)), ('x, "y"', "None", None)]
    wrong = _write(tmp_path / "b", one=["t,m,d", "a,1.5,29.02.2024"])
    with pytest.raises(Exception, match="d is not date"):
        readers.read_csv(spark, wrong, schema).collect()
    with pytest.raises(ValueError, match="twice"):
        readers.read_csv(spark, _write(tmp_path / "c", one=["t,t", "a,b"]), schema)
    (tmp_path / "d").mkdir()
    assert readers.read_csv(spark, str(tmp_path / "d"), schema).count() == 0
    assert readers.read_csv(spark, path, schema).agg(F.count("*")).first()[0] == 3
