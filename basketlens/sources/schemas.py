"""Declared input schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_DEMOGRAPHICS = (
    ("Married", T.IntegerType()),
    ("HouseholdSize", T.IntegerType()),
    ("Income", T.DoubleType()),
    ("Age", T.IntegerType()),
    ("ZipCode", T.StringType()),
    ("Work", T.IntegerType()),
    ("Education", T.IntegerType()),
)

TRANSACTIONS = _schema(
    ("CustomerID", T.StringType()),
    ("InvoiceNo", T.LongType()),
    ("InvoiceDate", T.DateType()),
    ("ProductID", T.StringType()),
    ("ProductCategory", T.StringType()),
    ("UnitPrice", T.DecimalType(12, 2)),
    ("Quantity", T.IntegerType()),
    *_DEMOGRAPHICS,
)

PROSPECTS = _schema(("CustomerID", T.StringType()), *_DEMOGRAPHICS)

RATINGS = _schema(
    ("respondent_id", T.StringType()),
    ("productNo", T.IntegerType()),
    ("price", T.DoubleType()),
    ("format", T.StringType()),
    ("strength", T.StringType()),
    ("origin", T.StringType()),
    ("sustainability", T.StringType()),
    ("rating", T.DoubleType()),
)

PROFILES = _schema(
    ("price", T.DoubleType()),
    ("format", T.StringType()),
    ("strength", T.StringType()),
    ("origin", T.StringType()),
    ("sustainability", T.StringType()),
)

# The product file spells one column this way; the reader renames it.
MISSPELT_COLUMNS = {"sustaintability_claim": "sustainability_claim"}

PRODUCTS = _schema(
    ("product_name", T.StringType()),
    ("num_servings", T.DoubleType()),
    ("price", T.DoubleType()),
    ("price_100g", T.DoubleType()),
    ("strength_level", T.DoubleType()),
    ("is_decaf", T.DoubleType()),
    ("sustaintability_claim", T.DoubleType()),
    ("convenience", T.DoubleType()),
    ("authenticity", T.DoubleType()),
    ("premium", T.DoubleType()),
    ("perceived_sustainability", T.DoubleType()),
    ("taste_quality", T.DoubleType()),
)

# star-schema tables that the views read; types as stored
STAR_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
