"""Queries on rated profiles: design, part-worths, willingness to pay, importance, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts as V
from ..operators import conjoint as J
from ..operators import quality as Q
from ..operators.regression import OlsFit
from ..sources import views
from ..session import written
from . import base as B
from . import solve
from .customers import BARS, _bars_sql, money_label_sql, percent_label_sql
from .shape import Book

book = Book()
add = book.add
SURVEY = J.Survey(levels=views.RATING_LEVELS)
LEVELS = views.RATING_LEVELS
PROPOSED = "LARGE / N / O / F"
SLOTS = SURVEY.level_slots()


def prepared(s: SparkSession, d: str) -> DataFrame:
    return J.prepare_ratings(views.ratings(s, d), SURVEY)


def ratings(s: SparkSession, d: str) -> DataFrame:
    """The ratings, written once for the steps of one query."""
    return written(prepared(s, d))


def profiles(s: SparkSession, d: str) -> DataFrame:
    return written(views.profiles(prepared(s, d)))


def panel(s: SparkSession, d: str) -> DataFrame:
    """Ratings by customer: about twenty-six each, some without all levels."""
    return J.prepare_ratings(views.ratings(s, d, "customer"), SURVEY)


def pooled(s: SparkSession, d: str) -> OlsFit:
    return J.pooled_fit(prepared(s, d), SURVEY)


def worths(s: SparkSession, d: str) -> DataFrame:
    return J.part_worths(s, pooled(s, d), SURVEY)


def coefficients(s: SparkSession, d: str) -> DataFrame:
    return J.respondent_coefficients(prepared(s, d), SURVEY)


def long_worths(s: SparkSession, d: str) -> DataFrame:
    return written(J.respondent_part_worths(coefficients(s, d), SURVEY))


def wtp(s: SparkSession, d: str) -> DataFrame:
    return written(J.respondent_wtp(coefficients(s, d), SURVEY))


def _utilities(s: SparkSession, d: str) -> tuple[DataFrame, OlsFit]:
    """Profiles with utilities and the model: the joined lines are read once."""
    rated = ratings(s, d)
    fit = J.pooled_fit(rated, SURVEY)
    return J.predict_utility(views.profiles(rated), fit, SURVEY), fit


def utilities(s: SparkSession, d: str) -> DataFrame:
    return _utilities(s, d)[0]


def shares(s: SparkSession, d: str) -> DataFrame:
    return J.logit_share(utilities(s, d))


def gaps(s: SparkSession, d: str, sets: tuple[str, ...] = ()) -> DataFrame:
    rows, fit = _utilities(s, d)
    return J.utility_gap(written(J.logit_share(rows, sets)), PROPOSED, fit.coefficient("price"), sets)


RATINGS = """ratings AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS respondent_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS INT) AS productNo,
         p_retailprice AS price, p_type AS format, l_returnflag AS strength, o_orderstatus AS origin,
         l_linestatus AS sustainability, l_quantity AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""
TERMS = SURVEY.terms
_dummies = [f"CASE WHEN {a} = '{v}' THEN 1.0 ELSE 0.0 END" for a, vs in LEVELS.items() for v in vs[1:]]
_design = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(["price", *_dummies]))
X = [f"x{i}" for i in range(len(TERMS))]
DESIGN = RATINGS + f", design AS (SELECT *, {_design} FROM ratings)"
MODEL = DESIGN + ",\n" + solve.ols_ctes("model", "design", X, "rating")


def _worth_rows(model: str, key: str = "") -> str:
    """Attribute, Level, Utility, Part_Worth, slope rows from solved coefficients."""
    head = f"{key}, " if key else ""
    rows = []
    for attribute, level, i in SLOTS:
        utility = "0.0" if i is None else f"b_{i}_0"
        family = [("0.0" if k is None else f"b_{k}_0") for a, _, k in SLOTS if a == attribute]
        worth = utility if attribute == J.PRICE else f"{utility} - ({' + '.join(family)}) / {len(family)}"
        rows.append(f"SELECT {head}'{attribute}' AS Attribute, '{level}' AS Level, {utility} AS Utility, {worth} AS Part_Worth, "
                    f"b_0_0 AS Price_Coefficient FROM {model}")
    return " UNION ALL ".join(rows)


WORTHS = MODEL + f",\nworths AS ({_worth_rows('model')})"
EACH = DESIGN + ",\n" + solve.moments_cte("each_m", "design", X, ["respondent_id"], ["rating"]) + ",\n" + solve.eliminate(
    "each_s", "each_m", len(X), ["b@_0"], ["respondent_id"]) + f",\neach AS ({_worth_rows('each_s', 'respondent_id')})"
WTP = EACH + """,
wtp AS (SELECT *, Part_Worth / abs(Price_Coefficient) AS WTP FROM each WHERE Attribute <> 'Price'),
clean AS (SELECT wtp.* FROM wtp CROSS JOIN (SELECT quantile_cont(WTP, 0.01) AS lo, quantile_cont(WTP, 0.99) AS hi FROM wtp)
          WHERE WTP BETWEEN lo AND hi)"""
PROFILES = RATINGS + """,
profiles AS (SELECT *, concat_ws(' / ', format, strength, origin, sustainability) AS Product FROM (
  SELECT format, strength, origin, sustainability, round(avg(price)) AS price FROM ratings GROUP BY ALL))"""
_x = {t: e for t, e in zip(TERMS, ["price", *_dummies])}
_utility = " + ".join(["intercept", *[f"b_{i}_0 * ({e})" for i, e in enumerate(_x.values())]])
SHARES = MODEL + "," + PROFILES.split("),", 1)[1] + f""",
utilities AS (SELECT profiles.*, {_utility} AS Predicted_Utility FROM profiles CROSS JOIN model),
shares AS (SELECT *, exp(Predicted_Utility) AS Exp_Utility,
           exp(Predicted_Utility) / sum(exp(Predicted_Utility)) OVER () AS Predicted_Market_Share FROM utilities),
gaps AS (SELECT *, own - Predicted_Utility AS Utility_Gap_vs_Proposed, (own - Predicted_Utility) / abs(slope) AS WTP_Equivalent_Gap
         FROM shares CROSS JOIN (SELECT Predicted_Utility AS own FROM shares WHERE Product = '{PROPOSED}')
         CROSS JOIN (SELECT b_0_0 AS slope FROM model))"""

# ------------------------------------------------------------------ design

add("conjoint_missing_profile", "Variable:s; Missing_Count:i",
    lambda s, d: Q.missing_profile(prepared(s, d)),
    " UNION ALL ".join(f"SELECT '{c}' AS Variable, count(*) FILTER (WHERE {c} IS NULL) AS Missing_Count FROM ratings" for c in (
        "respondent_id", "productNo", "price", "format", "strength", "origin", "sustainability", "rating")), RATINGS)
_levels = " UNION ALL ".join(f"SELECT '{n}' AS Attribute, count(DISTINCT {c}) AS Levels FROM profiles" for n, c in (
    ("Price", "price"), *((a.capitalize(), a) for a in LEVELS)))
_full = "(SELECT CAST(round(product(Levels)) AS BIGINT) FROM (" + _levels + "))"


def _efficiency(p: DataFrame) -> DataFrame:
    return J.design_efficiency(p, J.design_levels(p, SURVEY))


add("profiles_missing_profile", "Variable:s; Missing_Count:i", lambda s, d: Q.missing_profile(profiles(s, d)),
    " UNION ALL ".join(f"SELECT '{c}' AS Variable, count(*) FILTER (WHERE {c} IS NULL) AS Missing_Count FROM profiles" for c in (
        "Product", "price", "format", "strength", "origin", "sustainability")), PROFILES)
for _name, _frame, _source, _ctes in (
        ("ratings", prepared, "(SELECT * EXCLUDE (customer_id) FROM ratings)", RATINGS), ("profiles", profiles, "profiles", PROFILES)):
    add(f"duplicate_count_{_name}", "n_duplicates:i", lambda s, d, f=_frame: Q.duplicate_count(f(s, d)),
        f"SELECT (SELECT count(*) FROM {_source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_source})) AS n_duplicates", _ctes)
add("conjoint_design_levels", "Attribute:s; Levels:i", lambda s, d: J.design_levels(profiles(s, d), SURVEY), _levels, PROFILES)
add("design_efficiency", "Full_Factorial_Profiles:i; Selected_Profiles:i; Profiles_Not_Shown:i; Reduction_Percent:f",
    lambda s, d: _efficiency(profiles(s, d)),
    f"""SELECT f AS Full_Factorial_Profiles, n AS Selected_Profiles, f - n AS Profiles_Not_Shown,
    1 - n / f::DOUBLE AS Reduction_Percent FROM (SELECT count(*) AS n, {_full} AS f FROM profiles)""", PROFILES)
add("design_level_balance", "Attribute:s; Level:s; n:i", lambda s, d: J.level_balance(profiles(s, d), SURVEY),
    "SELECT 'Price' AS Attribute, CAST(CAST(price AS BIGINT) AS VARCHAR) AS Level, count(*) AS n FROM profiles GROUP BY 2"
    + "".join(f" UNION ALL SELECT '{a.capitalize()}', {a}, count(*) FROM profiles GROUP BY 2" for a in LEVELS), PROFILES)
_cor_names = [("price", "price")] + [
    (f"{a}{v}", f"CASE WHEN {a} = '{v}' THEN 1.0 ELSE 0.0 END") for a, vs in LEVELS.items() for v in sorted(vs)[1:]]
_corr = " UNION ALL ".join(
    f"SELECT '{a}' AS \"Row\", '{b}' AS \"Column\", corr({x}, {y}) AS Correlation FROM profiles"
    for a, x in _cor_names for b, y in _cor_names)
add("design_correlation", "Row:s; Column:s; Correlation:f", lambda s, d: J.design_correlation(profiles(s, d), SURVEY),
    _corr, PROFILES)
add("design_quality",
    "Profiles_Selected:i; Full_Factorial_Profiles:i; Reduction_Percent:s; Maximum_Absolute_Correlation:f",
    lambda s, d: (lambda p: J.design_quality(_efficiency(p), J.design_correlation(p, SURVEY)))(profiles(s, d)),
    f"""SELECT n AS Profiles_Selected, f AS Full_Factorial_Profiles, {percent_label_sql('1 - n / f::DOUBLE')} AS Reduction_Percent,
    round(m, 3) AS Maximum_Absolute_Correlation FROM (SELECT count(*) AS n, {_full} AS f FROM profiles) CROSS JOIN
    (SELECT max(abs(Correlation)) AS m FROM ({_corr}) WHERE "Row" <> "Column")""", PROFILES)

# ------------------------------------------------------------------ ratings and pooled model

add("prepare_ratings",
    "respondent_id:s; productNo:i; price:f; format:s; strength:s; origin:s; sustainability:s; rating:f", prepared,
    "SELECT * FROM ratings", RATINGS)
add("prepare_ratings_unknown_level", "origin:s; n:i",
    lambda s, d: Q.value_counts(J.prepare_ratings(views.ratings(s, d), J.Survey(levels={**LEVELS, "origin": ["F", "O"]})), "origin"),
    "SELECT CASE WHEN origin IN ('F', 'O') THEN origin END AS origin, count(*) AS n FROM ratings GROUP BY 1", RATINGS)
add("ratings_check", "Respondents:i; Profiles:i; Rows:i; Min_Rating:f; Max_Rating:f; Mean_Rating:f; Missing_Values:i",
    lambda s, d: J.ratings_check(ratings(s, d), SURVEY),
    """SELECT count(DISTINCT respondent_id) AS Respondents, count(DISTINCT productNo) AS Profiles, count(*) AS Rows,
    min(rating) AS Min_Rating, max(rating) AS Max_Rating, avg(rating) AS Mean_Rating, 0 AS Missing_Values FROM ratings""", RATINGS)
add("profile_rating_summary",
    "productNo:i; price:f; format:s; strength:s; origin:s; sustainability:s; Avg_Rating:f; Median_Rating:f; SD_Rating:f; Responses:i",
    lambda s, d: J.profile_rating_summary(ratings(s, d), SURVEY),
    """SELECT productNo, price, format, strength, origin, sustainability, avg(rating) AS Avg_Rating, median(rating) AS Median_Rating,
    stddev_samp(rating) AS SD_Rating, count(*) AS Responses FROM ratings GROUP BY ALL""", RATINGS)
add("pooled_conjoint", "term:s; estimate:f; std_error:f; statistic:f; p_value:f",
    lambda s, d: pooled(s, d).coefficients(s),
    "SELECT CASE term " + " ".join(f"WHEN 'x{i}' THEN '{t}'" for i, t in enumerate(TERMS))
    + " ELSE term END AS term, estimate, std_error, statistic, p_value FROM (" + solve.coefficient_rows("model", X) + ")", MODEL)
add("pooled_conjoint_summary", "n:i; df_residual:i; sigma:f; r_squared:f; adj_r_squared:f; f_statistic:f",
    lambda s, d: pooled(s, d).summary(s),
    f"""SELECT n, n - {len(X) + 1} AS df_residual, sqrt(sigma2) AS sigma, 1 - rss / ((n - 1) * yy_0) AS r_squared,
    1 - (rss / ((n - 1) * yy_0)) * (n - 1) / (n - {len(X) + 1}) AS adj_r_squared,
    (((n - 1) * yy_0 - rss) / {len(X)}) / sigma2 AS f_statistic FROM model""", MODEL)
WORTH = "Attribute:s; Level:s; Utility:f; Part_Worth:f"
add("average_conjoint_partworths", WORTH, worths, "SELECT * FROM worths", WORTHS)
add("average_wtp", WORTH + "; WTP:f4", lambda s, d: J.average_wtp(worths(s, d)),
    "SELECT *, Part_Worth / abs(Price_Coefficient) AS WTP FROM worths WHERE Attribute <> 'Price'", WORTHS)
add("average_wtp_from_base", WORTH + "; WTP:f4", lambda s, d: J.average_wtp(worths(s, d), "reference"),
    "SELECT *, Utility / abs(Price_Coefficient) AS WTP FROM worths WHERE Attribute <> 'Price'", WORTHS)
_order = {a: i + 1 for i, a in enumerate(SURVEY.attribute_name(a) for a in LEVELS)}
for _t, _v in (("part_worth", "Part_Worth"), ("wtp", "WTP")):
    _src = "SELECT *, Part_Worth / abs(Price_Coefficient) AS WTP FROM worths WHERE Attribute <> 'Price'"
    _pos = "CASE Attribute " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in _order.items()) + " END"
    _label = ", CASE WHEN WTP < 0 THEN concat('-', {m}) ELSE {m} END AS Label".format(m=money_label_sql("abs(WTP)", 2)) if _v == "WTP" else ""
    add(f"facets_{_t}", f"Attribute:s; Level:s; {_v}:f4; AttributeOrder:i; LevelOrder:i" + ("; Label:s" if _v == "WTP" else ""),
        lambda s, d, v=_v: V.facets(J.average_wtp(worths(s, d)), v, list(_order), label=v == "WTP"),
        f"""SELECT Attribute, Level, {_v}, {_pos} AS AttributeOrder,
        row_number() OVER (PARTITION BY Attribute ORDER BY {_v}, Level) AS LevelOrder{_label} FROM ({_src})""", WORTHS)

# ------------------------------------------------------------------ respondents

add("respondent_conjoint_partworths", "respondent_id:s; " + WORTH, long_worths, "SELECT * FROM each", EACH)
_families, _at = [], 1
for _vs in LEVELS.values():
    _families.append(list(range(_at, _at + len(_vs) - 1)))
    _at += len(_vs) - 1
_absent = {0: "FALSE"}
for _family in _families:
    _no_base = " + ".join(f"m_{i}" for i in _family) + " > 1 - 1e-12"
    for _i in _family:
        _before = " AND ".join(["TRUE", *[f"m_{h} = 0" for h in _family if h < _i]])
        _absent[_i] = f"(m_{_i} = 0 OR (({_no_base}) AND {_before}))"
_k = len(X)
_safe = ", ".join([f"coalesce(a_{i}_{j}, 0) AS a_{i}_{j}" for i in range(_k) for j in range(_k)]
                  + [f"coalesce(b_{i}_0, 0) AS b_{i}_0" for i in range(_k)]
                  + [f"coalesce(a_{i}_{i}, 0) AS o_{i}" for i in range(_k)] + [f"{_absent[i]} AS absent_{i}" for i in range(_k)])
_kept_columns = ["customer_id", *[f"o_{i}" for i in range(_k)], *[f"absent_{i}" for i in range(_k)]]
PANEL = DESIGN + ",\n" + solve.moments_cte("panel_m", "design", X, ["customer_id"], ["rating"]) + f""",
panel_i AS (SELECT customer_id, {_safe} FROM panel_m),
""" + solve.eliminate("panel_s", "panel_i", _k, ["b@_0"], _kept_columns,
                      guard="(NOT absent_{k} AND o_{k} > 0 AND a_{k}_{k} > 1e-10 * o_{k})") + f""",
panel_c AS (SELECT customer_id AS respondent_id, {', '.join(
    f'CASE WHEN absent_{i} THEN 0 WHEN u_{i} THEN b_{i}_0 END AS b_{i}_0' for i in range(_k))} FROM panel_s),
each_customer AS ({_worth_rows('panel_c', 'respondent_id')})"""
add("respondent_panel_partworths", "respondent_id:s; Attribute:s; Level:s; Utility:f4; Part_Worth:f4",
    lambda s, d: J.respondent_part_worths(J.respondent_coefficients(panel(s, d), SURVEY), SURVEY),
    "SELECT * FROM each_customer", PANEL)
add("respondent_check", "Respondents:i; Rows:i; Attributes:i; Levels:i", lambda s, d: J.respondent_check(long_worths(s, d), SURVEY),
    "SELECT count(DISTINCT respondent_id) AS Respondents, count(*) AS Rows, count(DISTINCT Attribute) AS Attributes, "
    "count(DISTINCT Level) AS Levels FROM each", EACH)
_ws = """SELECT Attribute, Level, avg(Part_Worth) AS Mean_Part_Worth, median(Part_Worth) AS Median_Part_Worth,
  stddev_samp(Part_Worth) AS SD_Part_Worth, min(Part_Worth) AS Min_Part_Worth, max(Part_Worth) AS Max_Part_Worth FROM each GROUP BY ALL"""
add("respondent_partworth_summary",
    "Attribute:s; Level:s; Mean_Part_Worth:f; Median_Part_Worth:f; SD_Part_Worth:f; Min_Part_Worth:f; Max_Part_Worth:f",
    lambda s, d: J.part_worth_summary(long_worths(s, d)), _ws, EACH)
add("partworth_report_table", "Attribute:s; Level:s; Mean part-worth:f; Median part-worth:f; SD:f",
    lambda s, d: J.part_worth_report(J.part_worth_summary(long_worths(s, d))),
    f"""SELECT Attribute, Level, round(Mean_Part_Worth, 3) AS "Mean part-worth", round(Median_Part_Worth, 3) AS "Median part-worth",
    round(SD_Part_Worth, 3) AS "SD" FROM ({_ws})""", EACH)
WTP_COLUMNS = "respondent_id:s; " + WORTH + "; Price_Coefficient:f; WTP:f3"
add("respondent_wtp", WTP_COLUMNS, wtp, "SELECT * FROM wtp", WTP)
add("respondent_wtp_joined", WTP_COLUMNS, lambda s, d: J.respondent_wtp_joined(long_worths(s, d), SURVEY), "SELECT * FROM wtp", WTP)
add("respondent_level_wtp_clean", WTP_COLUMNS, lambda s, d: J.trimmed_wtp(wtp(s, d)), "SELECT * FROM clean", WTP)
_wsum = """SELECT Attribute, Level, avg(WTP) AS Mean_WTP, median(WTP) AS Median_WTP, stddev_samp(WTP) AS SD_WTP FROM clean GROUP BY ALL"""
add("respondent_wtp_summary", "Attribute:s; Level:s; Mean_WTP:f3; Median_WTP:f3; SD_WTP:f3",
    lambda s, d: J.wtp_summary(written(J.trimmed_wtp(wtp(s, d)))), _wsum, WTP)
_signed = lambda c: f"CASE WHEN {c} < 0 THEN concat('-', {money_label_sql(f'abs({c})', 2)}) ELSE {money_label_sql(c, 2)} END"
add("wtp_report_table", "Attribute:s; Level:s; Mean WTP (£):s; Median WTP (£):s; SD WTP:f",
    lambda s, d: J.wtp_report(J.wtp_summary(written(J.trimmed_wtp(wtp(s, d))))),
    f"""SELECT Attribute, Level, {_signed('Mean_WTP')} AS "Mean WTP (£)", {_signed('Median_WTP')} AS "Median WTP (£)",
    round(SD_WTP, 3) AS "SD WTP" FROM ({_wsum})""", WTP)

# ------------------------------------------------------------------ importance and shares

IMPORTANCE_SQL = """SELECT *, Utility_Range / sum(Utility_Range) OVER () AS Importance FROM (
  SELECT Attribute, max(Part_Worth) AS Max_Part_Worth, min(Part_Worth) AS Min_Part_Worth,
         max(Part_Worth) - min(Part_Worth) AS Utility_Range FROM worths WHERE Attribute <> 'Price' GROUP BY 1
  UNION ALL SELECT Attribute, Part_Worth * lo, Part_Worth * hi, abs(Part_Worth) * (hi - lo) FROM worths
  CROSS JOIN (SELECT min(price) AS lo, max(price) AS hi FROM ratings) WHERE Attribute = 'Price')"""


def importance(s: SparkSession, d: str) -> DataFrame:
    rated = ratings(s, d)
    return J.attribute_importance(J.part_worths(s, J.pooled_fit(rated, SURVEY), SURVEY), rated, SURVEY)


add("conjoint_attribute_importance",
    "Attribute:s; Max_Part_Worth:f; Min_Part_Worth:f; Utility_Range:f; Importance:f; Importance_Percent:s", importance,
    f"SELECT *, {percent_label_sql('Importance')} AS Importance_Percent FROM ({IMPORTANCE_SQL})", WORTHS)
add("conjoint_attribute_importance_report_table", "Attribute:s; Utility range:f; Importance (%):s",
    lambda s, d: J.importance_report(importance(s, d)),
    f"""SELECT Attribute, round(Utility_Range, 3) AS "Utility range", {percent_label_sql('Importance')} AS "Importance (%)"
    FROM ({IMPORTANCE_SQL})""", WORTHS)
add("bars_attribute_importance", BARS, lambda s, d: V.percent_bars(importance(s, d), "Attribute", "Importance"),
    _bars_sql(IMPORTANCE_SQL, "Attribute", "Importance", percent_label_sql("Importance")), WORTHS)
PRODUCT = "Product:s; price:f; Predicted_Utility:f; "
add("predict_utility", PRODUCT.rstrip("; "), utilities, "SELECT * FROM utilities", SHARES)
add("conjoint_market_share_prediction",
    PRODUCT + "Exp_Utility:f0; Predicted_Market_Share:f; Predicted_Market_Share_Percent:s", shares,
    f"SELECT *, {percent_label_sql('Predicted_Market_Share')} AS Predicted_Market_Share_Percent FROM shares", SHARES)
_set_share = """(SELECT *, exp(Predicted_Utility) / sum(exp(Predicted_Utility)) OVER (PARTITION BY format) AS Predicted_Market_Share
  FROM utilities)"""
add("market_share_by_choice_set", "format:s; Product:s; Predicted_Utility:f; Predicted_Market_Share:f",
    lambda s, d: J.logit_share(utilities(s, d), ["format"]), f"SELECT * FROM {_set_share}", SHARES)
add("conjoint_market_share_report_table", "Product:s; Predicted utility:f; Predicted market share:s",
    lambda s, d: J.share_report(shares(s, d), "format"),
    f"""SELECT Product, round(Predicted_Utility, 3) AS "Predicted utility",
    {percent_label_sql('Predicted_Market_Share')} AS "Predicted market share" FROM shares""", SHARES)
add("proposed_product_market_share",
    "Product:s; Predicted_Utility:f; Predicted_Market_Share:f; Predicted_Market_Share_Percent:s",
    lambda s, d: J.proposed_share(shares(s, d), PROPOSED),
    f"""SELECT *, {percent_label_sql('Predicted_Market_Share')} AS Predicted_Market_Share_Percent FROM shares
    WHERE Product = '{PROPOSED}'""", SHARES)
add("share_report_by_choice_set", "format:s; Product:s; origin:s; Predicted utility:f; Predicted market share:s",
    lambda s, d: J.share_report(J.logit_share(utilities(s, d), ["format"]), "origin", ["format"]),
    f"""SELECT format, Product, origin, round(Predicted_Utility, 3) AS "Predicted utility",
    {percent_label_sql('Predicted_Market_Share')} AS "Predicted market share" FROM {_set_share}""", SHARES)
add("proposed_share_by_choice_set", "format:s; Product:s; Predicted_Utility:f; Predicted_Market_Share:f",
    lambda s, d: J.proposed_share(J.logit_share(utilities(s, d), ["format"]), PROPOSED, ["format"]),
    f"SELECT * FROM {_set_share} WHERE Product = '{PROPOSED}'", SHARES)
add("gap_report_by_choice_set", "format:s; Closest competitor:s; Competitor utility:f",
    lambda s, d: J.gap_report(J.closest_competitor(gaps(s, d), PROPOSED, ["format"]), ["format"]),
    f"""SELECT format, Product AS "Closest competitor", round(Predicted_Utility, 3) AS "Competitor utility" FROM (SELECT *, row_number()
    OVER (PARTITION BY format ORDER BY Predicted_Utility DESC, Product) AS k FROM gaps WHERE Product <> '{PROPOSED}') WHERE k = 1""", SHARES)
add("conjoint_market_share_gap_analysis",
    PRODUCT + "Predicted_Market_Share:f; Utility_Gap_vs_Proposed:f; WTP_Equivalent_Gap:f3", gaps, "SELECT * FROM gaps", SHARES)
_closest = f"(SELECT * FROM gaps WHERE Product <> '{PROPOSED}' ORDER BY Predicted_Utility DESC, Product LIMIT 1)"
add("closest_competitor_gap", "Product:s; Predicted_Utility:f; Utility_Gap_vs_Proposed:f; WTP_Equivalent_Gap:f3",
    lambda s, d: J.closest_competitor(gaps(s, d), PROPOSED), f"SELECT * FROM {_closest}", SHARES)
add("closest_competitor_by_choice_set", "format:s; Product:s; Predicted_Utility:f",
    lambda s, d: J.closest_competitor(gaps(s, d), PROPOSED, ["format"]),
    f"""SELECT format, Product, Predicted_Utility FROM (SELECT *, row_number() OVER (PARTITION BY format
    ORDER BY Predicted_Utility DESC, Product) AS k FROM gaps WHERE Product <> '{PROPOSED}') WHERE k = 1""", SHARES)
add("closest_competitor_gap_report_table",
    "Closest competitor:s; Competitor utility:f; Utility advantage of proposed product:f; WTP-equivalent advantage (£):s",
    lambda s, d: J.gap_report(J.closest_competitor(gaps(s, d), PROPOSED)),
    f"""SELECT Product AS "Closest competitor", round(Predicted_Utility, 3) AS "Competitor utility",
    round(Utility_Gap_vs_Proposed, 3) AS "Utility advantage of proposed product",
    {_signed('WTP_Equivalent_Gap')} AS "WTP-equivalent advantage (£)" FROM {_closest}""", SHARES)
add("bars_market_share", BARS, lambda s, d: V.percent_bars(shares(s, d), "Product", "Predicted_Market_Share"),
    _bars_sql("SELECT * FROM shares", "Product", "Predicted_Market_Share", percent_label_sql("Predicted_Market_Share")), SHARES)

QUERIES, SQL = book.queries, book.sql
