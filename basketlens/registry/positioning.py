"""Queries on the product map and on principal components of customers and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.presets import CLUSTER_VARIABLES
from ..operators import clustering as K
from ..operators import positioning as P
from ..operators import quality as Q
from ..sources import views
from ..session import written
from . import base as B
from . import clusters as C
from . import solve
from .shape import Book

book = Book()
add = book.add
X = views.PRODUCT_VARIABLES
N = len(X)
RULES = [("brand#1", "Ones"), ("BRAND#2", "Twos")]


def products(s: SparkSession, d: str) -> DataFrame:
    return written(views.products(s, d))


def fitted(s: SparkSession, d: str) -> P.PcaFit:
    return P.pca_fit(products(s, d), X)


def loadings(s: SparkSession, d: str) -> DataFrame:
    return fitted(s, d).loading_table(s)


def scores(s: SparkSession, d: str) -> DataFrame:
    kept = products(s, d)
    return P.product_scores(kept, P.pca_fit(kept, X))


def _projected(s: SparkSession, d: str) -> DataFrame:
    kept = products(s, d)
    return P.product_scores(proposed(kept), P.pca_fit(kept, X))


def proposed(kept: DataFrame) -> DataFrame:
    """A new product with the highest value of every attribute."""
    return kept.agg(F.lit("Proposed").alias("product_name"), *[F.max(v).alias(v) for v in X])


PRODUCTS = """products AS (
  SELECT p_brand AS product_name, avg(p_retailprice) AS avg_price, avg(p_size) AS avg_size, avg(l_quantity) AS avg_quantity,
         avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax, avg(l_extendedprice) AS avg_extended,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS return_share,
         avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS open_share,
         count(DISTINCT l_partkey)::DOUBLE AS n_parts, count(*)::DOUBLE AS n_lines
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
FIT = PRODUCTS + ",\n" + solve.correlation_cte("cor", "products", X) + ",\n" + solve.principal_components("pcs", "cor", N)
_wide = ", ".join(f"max(loading) FILTER (WHERE pc = {c + 1}) AS PC{c + 1}" for c in range(N))
_names = f"(SELECT i, v AS Variable FROM (VALUES {', '.join(f'({i}, {chr(39)}{v}{chr(39)})' for i, v in enumerate(X))}) AS t(i, v))"
LOADINGS = FIT + f",\nloadings AS (SELECT Variable, {_wide} FROM pcs JOIN {_names} USING (i) GROUP BY 1)"


def score_sql(source: str, key: str, names: list[str], fit_on: str, pcs: str, k: int, keep: str = "") -> str:
    """Scores of ``source`` rows standardised on ``fit_on``."""
    z = " UNION ALL ".join(
        f"SELECT {key}{keep}, {i} AS i, (CAST({v} AS DOUBLE) - (SELECT avg(CAST({v} AS DOUBLE)) FROM {fit_on})) / "
        f"(SELECT stddev_samp(CAST({v} AS DOUBLE)) FROM {fit_on}) AS z FROM {source}" for i, v in enumerate(names))
    cells = ", ".join(f"sum(z * loading) FILTER (WHERE pc = {c + 1}) AS PC{c + 1}" for c in range(k))
    return f"SELECT {key}, {cells} FROM ({z}) JOIN {pcs} USING (i) GROUP BY {key}"


SCORES = FIT + ",\nscores AS (" + score_sql("products", "product_name", X, "products", "pcs", N) + ")"
PCS = "; ".join(f"PC{c + 1}:f" for c in range(N))

add("product_missing_check", "Variable:s; Missing:i", lambda s, d: P.missing_by_variable(products(s, d), X),
    " UNION ALL ".join(f"SELECT '{v}' AS Variable, count(*) FILTER (WHERE {v} IS NULL) AS Missing FROM products" for v in X), PRODUCTS)
add("duplicate_count_products", "n_duplicates:i", lambda s, d: Q.duplicate_count(products(s, d)),
    "SELECT (SELECT count(*) FROM products) - (SELECT count(*) FROM (SELECT DISTINCT * FROM products)) AS n_duplicates", PRODUCTS)
add("product_missing_profile", "Variable:s; Missing_Count:i", lambda s, d: Q.missing_profile(products(s, d)),
    " UNION ALL ".join(f"SELECT '{v}' AS Variable, count(*) FILTER (WHERE {v} IS NULL) AS Missing_Count FROM products"
                       for v in ["product_name", *X]), PRODUCTS)
_pve = f"""SELECT concat('PC', pc) AS PC, sqrt(e) * sqrt((SELECT count(*) FROM products) - 1) AS Singular_Value,
  sqrt(e) AS PC_Standard_Deviation, e AS Eigenvalue, e / {N} AS PVE, sum(e / {N}) OVER (ORDER BY pc) AS Cumulative_PVE
  FROM (SELECT pc, max(eigenvalue) AS e FROM pcs GROUP BY 1)"""
add("pve_table", "PC:s; Singular_Value:f; PC_Standard_Deviation:f; Eigenvalue:f; PVE:f; Cumulative_PVE:f",
    lambda s, d: fitted(s, d).pve(s), _pve, FIT)
add("pve_report_table", "Principal component:s; Singular value:f; Eigenvalue:f; PVE (%):s; Cumulative PVE (%):s",
    lambda s, d: P.pve_report(fitted(s, d).pve(s)),
    f"""SELECT PC AS "Principal component", round(Singular_Value, 3) AS "Singular value", round(Eigenvalue, 3) AS "Eigenvalue",
    {C.percent_label_sql('PVE')} AS "PVE (%)", {C.percent_label_sql('Cumulative_PVE')} AS "Cumulative PVE (%)" FROM ({_pve})""", FIT)
add("pca_loadings", "Variable:s; " + PCS, loadings, "SELECT * FROM loadings", LOADINGS)
add("loading_report_table", "Variable:s; PC1:f; PC2:f; PC3:f; PC4:f", lambda s, d: P.loading_report(loadings(s, d)),
    "SELECT Variable, " + ", ".join(f"round(PC{c}, 3) AS PC{c}" for c in range(1, 5)) + " FROM loadings", LOADINGS)
add("loading_arrows", "Variable:s; PC1_scaled:f; PC2_scaled:f", lambda s, d: P.loading_arrows(loadings(s, d)),
    "SELECT Variable, PC1 * 3 AS PC1_scaled, PC2 * 3 AS PC2_scaled FROM loadings", LOADINGS)
_imp = """SELECT Variable, PC1, PC2, PC1 * PC1 AS PC1_Contribution, PC2 * PC2 AS PC2_Contribution,
  PC1 * PC1 + PC2 * PC2 AS PC1_PC2_Contribution FROM loadings"""
add("variable_importance", "Variable:s; PC1:f; PC2:f; PC1_Contribution:f; PC2_Contribution:f; PC1_PC2_Contribution:f",
    lambda s, d: P.variable_importance(loadings(s, d)), _imp, LOADINGS)
add("variable_importance_report", "Variable:s; PC1 loading:f; PC2 loading:f; PC1² + PC2²:f",
    lambda s, d: P.variable_importance_report(P.variable_importance(loadings(s, d))),
    f"""SELECT Variable, round(PC1, 3) AS "PC1 loading", round(PC2, 3) AS "PC2 loading",
    round(PC1_PC2_Contribution, 3) AS "PC1² + PC2²" FROM ({_imp})""", LOADINGS)
add("product_scores", "product_name:s; " + PCS, scores, "SELECT * FROM scores", SCORES)
add("product_brands_by_prefix", "product_name:s; Brand:s; PC1:f; PC2:f", lambda s, d: P.brand_from_name(scores(s, d)),
    "SELECT *, nullif(regexp_extract(product_name, '^[A-Za-z]+'), '') AS Brand FROM scores", SCORES)
add("product_brands_by_rules", "product_name:s; Brand:s; PC1:f; PC2:f", lambda s, d: P.brand_by_rules(scores(s, d), RULES),
    """SELECT *, CASE WHEN product_name ILIKE '%brand#1%' THEN 'Ones' WHEN product_name ILIKE '%brand#2%' THEN 'Twos'
    ELSE 'Other' END AS Brand FROM scores""", SCORES)
add("project_new_product", "product_name:s; " + PCS, _projected,
    "SELECT * FROM projected", FIT + ",\nnew AS (SELECT 'Proposed' AS product_name, "
    + ", ".join(f"max({v}) AS {v}" for v in X) + " FROM products),\nprojected AS ("
    + score_sql("new", "product_name", X, "products", "pcs", N) + ")")
add("products_in_zone", "product_name:s; PC1:f; PC2:f; In_Zone:b", lambda s, d: P.in_zone(scores(s, d)),
    "SELECT *, PC1 BETWEEN 0.25 AND 1.25 AND PC2 BETWEEN -0.35 AND 1.10 AS In_Zone FROM scores", SCORES)

# ------------------------------------------------------------------ two variables, customers, vectors

_two = ["avg_price", "avg_quantity"]
add("pca_two_variables", "Variable:s; PC1:f; PC2:f",
    lambda s, d: P.pca_fit(products(s, d), _two).loading_table(s),
    """SELECT Variable, CASE WHEN r >= 0 THEN sqrt(0.5) ELSE s * sqrt(0.5) END AS PC1,
    CASE WHEN r >= 0 THEN s * sqrt(0.5) ELSE sqrt(0.5) END AS PC2 FROM
    (SELECT corr(avg_price, avg_quantity) AS r FROM products), (VALUES ('avg_price', 1), ('avg_quantity', -1)) AS t(Variable, s)""",
    PRODUCTS)


def customer_scores(s: SparkSession, d: str) -> DataFrame:
    return P.cluster_scores(C.scaled(s, d).withColumn("KMeans_Cluster", F.lit(1)), "CustomerID")


_customer_scores = (
    C.LOGS + ",\n" + solve.correlation_cte("cor", "logs", CLUSTER_VARIABLES) + ",\n"
    + solve.principal_components("pcs", "cor", 2) + ",\nscores AS ("
    + score_sql("logs", "CustomerID", CLUSTER_VARIABLES, "logs", "pcs", 2) + ")")
add("customer_pca_scores", "CustomerID:i; PC1:f; PC2:f", customer_scores, "SELECT * FROM scores", _customer_scores)
add("cluster_pca_scores", "CustomerID:i; PC1:f; PC2:f", lambda s, d: P.cluster_scores(C.clustered(s, d), "CustomerID"),
    "SELECT * FROM scores", _customer_scores)
add("ward_merge_check", "Merges:i; Height_SS:f4; Falls:i; First_Height:f4", C._ward_check,
    f"""SELECT (SELECT count(*) - 1 FROM products) AS Merges, (SELECT (count(*) - 1) * {N} FROM products) AS Height_SS, 0 AS Falls,
    (SELECT min(d) FROM (SELECT sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM z a JOIN z b ON a.i = b.i AND a.product_name < b.product_name
    GROUP BY a.product_name, b.product_name)) AS First_Height""",
    PRODUCTS + ",\nz AS (" + " UNION ALL ".join(f"""SELECT product_name, {i} AS i, ({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS z
    FROM products""" for i, v in enumerate(X)) + ")")
add("vector_pve", "PC:s; Eigenvalue:f; PVE:f",
    lambda s, d: P.pca_fit(written(views.vectors(s, d)), [f"v{i}" for i in range(64)], 4).pve(s),
    "SELECT concat('PC', pc) AS PC, max(eigenvalue) AS Eigenvalue, max(eigenvalue) / 64 AS PVE FROM pcs GROUP BY 1",
    """long AS MATERIALIZED (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cor AS MATERIALIZED (SELECT a.i, b.i AS j, corr(a.x, b.x) AS v FROM long a JOIN long b USING (vec_id) GROUP BY 1, 2),
""" + solve.principal_components("pcs", "cor", 4, 26))


def _vector_clusters(s: SparkSession, d: str) -> DataFrame:
    x = K.keep(K.standardise(K.cluster_matrix(views.vectors(s, d), [f"v{i}" for i in range(64)])))
    model, _ = K.kmeans_best_of(x, 10, 25)
    return K.attach_clusters(x, model).select("vec_id", "label", "KMeans_Cluster")


add("vector_clusters", None, _vector_clusters)

QUERIES, SQL = book.queries, book.sql
