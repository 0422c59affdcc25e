"""The logical inputs as views over star-schema tables (region, nation, customer, part, orders, lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table

FOCUS = "red widget"

# Level lists of the ratings view; the first level is the regression base.
RATING_LEVELS = {
    "format": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "strength": ["A", "N", "R"],
    "origin": ["F", "O", "P"],
    "sustainability": ["F", "O"],
}

PRODUCT_VARIABLES = [
    "avg_price", "avg_size", "avg_quantity", "avg_discount", "avg_tax", "avg_extended", "return_share", "open_share",
    "n_parts", "n_lines",
]


def _demographics() -> dict:
    key = F.col("c_custkey")
    return {
        "Married": F.when(key % 7 < 4, 1).otherwise(0),
        "HouseholdSize": F.col("n_regionkey"),
        "Income": F.col("c_acctbal"),
        "Age": (F.lit(18) + key % 63).cast("int"),
        "ZipCode": F.col("c_nationkey").cast("string"),
        "Work": F.col("c_mktsegment"),
        "Education": (key % 4).cast("int"),
    }


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customer attributes. The nation table has 25 rows by definition, hence the broadcast."""
    joined = read_table(spark, sf, "customer").join(
        F.broadcast(read_table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_custkey").alias("CustomerID"), *[c.alias(k) for k, c in _demographics().items()])


def _tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Lines, parts, orders and people, each with only the columns that a transaction line has, under their names there."""
    quantity, date, price = F.col("l_quantity").cast("int"), F.col("o_orderdate").cast("date"), F.col("p_retailprice").cast("decimal(12,2)")
    return [
        read_table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("InvoiceNo"), F.col("l_partkey").alias("ProductID"), quantity.alias("Quantity")),
        read_table(spark, sf, "part").select(
            F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("ProductCategory"), price.alias("UnitPrice")),
        read_table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("InvoiceNo"), F.col("o_custkey").alias("CustomerID"), date.alias("InvoiceDate")),
        customers(spark, sf),
    ]


def joined(line: DataFrame, part: DataFrame, order: DataFrame, people: DataFrame) -> DataFrame:
    """One row per transaction line with every column of the four tables.

    Orders meet their customers first, so that lines move twice; what they are left partitioned by is their order, not a
    customer with many of them.
    """
    return line.join(part, "ProductID").join(order.join(people, "CustomerID"), "InvoiceNo").select(
        "CustomerID", "InvoiceNo", "InvoiceDate", "ProductID", "ProductCategory", "UnitPrice", "Quantity",
        *[c for c in people.columns if c != "CustomerID"])


def retail(spark: SparkSession, sf: str) -> DataFrame:
    """One row per transaction line."""
    return joined(*_tables(spark, sf))


def raw_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The tables whose join is ``raw_transactions``: lines with repeated rows, parts with missing categories, orders, people."""
    line, part, *others = _tables(spark, sf)
    copies = F.when(F.col("InvoiceNo") % 97 == 0, 2).otherwise(1)
    category = F.when(F.col("ProductID") % 50 != 0, F.col("ProductCategory"))
    repeated = line.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")
    return [repeated, part.withColumn("ProductCategory", category), *others]


def raw_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with repeated rows and missing categories, from one pass over the joined lines."""
    return joined(*raw_tables(spark, sf))


def prospects(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth customer stands for a person without purchases known to the model."""
    return customers(spark, sf).where(F.col("CustomerID") % 5 == 0)


def ratings(spark: SparkSession, sf: str, respondent: str = "nation") -> DataFrame:
    """Rated profiles. Respondents are nations (well covered) or customers (some with gaps)."""
    line = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = read_table(spark, sf, "part")
    order = read_table(spark, sf, "orders")
    person = read_table(spark, sf, "customer")
    joined = (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    if respondent == "nation":
        joined = joined.join(person, F.col("o_custkey") == F.col("c_custkey"))
        who = F.col("c_nationkey")
    else:
        who = F.col("o_custkey")
    return joined.select(
        who.cast("string").alias("respondent_id"),
        F.col("l_partkey").cast("int").alias("productNo"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("format"),
        F.col("l_returnflag").alias("strength"),
        F.col("o_orderstatus").alias("origin"),
        F.col("l_linestatus").alias("sustainability"),
        F.col("l_quantity").alias("rating"),
    )


def profiles(rated: DataFrame) -> DataFrame:
    """Each attribute combination that was rated, at its average price in whole units."""
    return (
        rated.groupBy("format", "strength", "origin", "sustainability")
        .agg(F.round(F.avg("price")).alias("price"))
        .withColumn("Product", F.concat_ws(" / ", "format", "strength", "origin", "sustainability"))
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """One row per brand with averages over its lines."""
    line = read_table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    part = read_table(spark, sf, "part")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("product_name"))
        .agg(
            F.avg("p_retailprice").alias("avg_price"),
            F.avg("p_size").alias("avg_size"),
            F.avg("l_quantity").alias("avg_quantity"),
            F.avg("l_discount").alias("avg_discount"),
            F.avg("l_tax").alias("avg_tax"),
            F.avg("l_extendedprice").alias("avg_extended"),
            F.avg((F.col("l_returnflag") == "R").cast("double")).alias("return_share"),
            F.avg((F.col("l_linestatus") == "O").cast("double")).alias("open_share"),
            F.count_distinct("l_partkey").cast("double").alias("n_parts"),
            F.count(F.lit(1)).cast("double").alias("n_lines"),
        )
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as 64 numeric columns v0..v63 with their known class."""
    df = read_table(spark, sf, "embeddings")
    return df.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(64)])
