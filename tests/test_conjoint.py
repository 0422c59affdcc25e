"""Part-worths against known utilities and against a direct least-squares fit."""

import itertools
import math

import numpy as np
import pytest

from basketlens.operators import conjoint
from basketlens.functions.presets import SURVEY_LEVELS
from basketlens.sources import schemas

SURVEY = conjoint.Survey()
WORTH = {
    "format": [0.0, 2.0, 1.0, -1.0], "strength": [0.0, 0.5, 1.5], "origin": [0.0, 1.0, 0.25], "sustainability": [0.0, 0.75],
}


def _utility(profile, slope):
    price, *levels = profile
    return 3.0 + slope * price + sum(WORTH[a][SURVEY_LEVELS[a].index(v)] for a, v in zip(SURVEY_LEVELS, levels))


@pytest.fixture(scope="module")
def full(spark):
    """All 288 profiles rated without noise by two people."""
    profiles = list(itertools.product([3.0, 4.0, 5.0, 6.0], *SURVEY_LEVELS.values()))
    data = [(who, i, *p, _utility(p, s)) for who, s in (("r1", -0.5), ("r2", -2.0)) for i, p in enumerate(profiles)]
    columns = ["respondent_id", "productNo", "price", *SURVEY_LEVELS, "rating"]
    return conjoint.prepare_ratings(spark.createDataFrame(data, columns), SURVEY).persist()


def test_design(spark, full, rows):
    profiles = full.where("respondent_id = 'r1'").select("price", *SURVEY_LEVELS)
    got = rows(conjoint.design_efficiency(profiles, conjoint.design_levels(profiles, SURVEY)))[0]
    assert got == {"Full_Factorial_Profiles": 288, "Selected_Profiles": 288, "Profiles_Not_Shown": 0, "Reduction_Percent": 0.0}
    balance = {(r["Attribute"], r["Level"]): r["n"] for r in rows(conjoint.level_balance(profiles, SURVEY))}
    assert balance[("Price", "3")] == 72 and balance[("Sustainability", "Yes")] == 144 and len(balance) == 16
    corr = conjoint.design_correlation(profiles, SURVEY)
    # dummies of one four-level attribute correlate by -1/3, attributes among one another not at all
    assert conjoint.max_design_correlation(corr).first()[0] == pytest.approx(0.5)


def test_pooled_recovers_utilities(spark, full, rows):
    fit = conjoint.pooled_fit(full, SURVEY)
    assert fit.coefficient("price") == pytest.approx(-1.25)
    table = {(r["Attribute"], r["Level"]): r for r in rows(conjoint.part_worths(spark, fit, SURVEY))}
    assert table[("Format", "Capsule")]["Utility"] == pytest.approx(2.0)
    assert table[("Format", "Capsule")]["Part_Worth"] == pytest.approx(1.5)
    for attribute in ("Format", "Strength", "Origin", "Sustainability"):
        assert sum(r["Part_Worth"] for (a, _), r in table.items() if a == attribute) == pytest.approx(0.0)
    wtp = {(r["Attribute"], r["Level"]): r["WTP"] for r in rows(conjoint.average_wtp(conjoint.part_worths(spark, fit, SURVEY)))}
    assert wtp[("Format", "Capsule")] == pytest.approx(1.5 / 1.25)


def test_respondents_recover_utilities(full, rows):
    coefficients = conjoint.respondent_coefficients(full, SURVEY)
    got = {(r["respondent_id"], r["Level"]): r for r in rows(conjoint.respondent_part_worths(coefficients, SURVEY))}
    assert len(got) == 26
    assert got[("r1", "Price")]["Part_Worth"] == pytest.approx(-0.5) and got[("r2", "Price")]["Part_Worth"] == pytest.approx(-2.0)
    assert got[("r2", "Dark")]["Utility"] == pytest.approx(1.5) and got[("r1", "Mild")]["Utility"] == 0.0
    wtp = {(r["respondent_id"], r["Level"]): r["WTP"] for r in rows(conjoint.respondent_wtp(coefficients, SURVEY))}
    joined = {(r["respondent_id"], r["Level"]): r["WTP"] for r in rows(conjoint.respondent_wtp_joined(
        conjoint.respondent_part_worths(coefficients, SURVEY), SURVEY))}
    assert wtp[("r1", "Capsule")] == pytest.approx(3.0) and wtp == pytest.approx(joined)


def test_gaps_in_what_a_respondent_saw(spark, full, rows):
    data = [r.asDict() for r in full.collect()]
    no_base = [{**r, "respondent_id": "no_base"} for r in data if r["respondent_id"] == "r1" and r["format"] != "Instant"]
    no_level = [{**r, "respondent_id": "no_level"} for r in data if r["respondent_id"] == "r1" and r["strength"] != "Dark"]
    one_price = [{**r, "respondent_id": "one_price"} for r in data if r["respondent_id"] == "r1" and r["price"] == 4.0]
    aliased = [{**r, "respondent_id": "aliased"} for r in data if r["respondent_id"] == "r1"
               and (r["strength"] == "Dark") == (r["sustainability"] == "Yes")]
    df = spark.createDataFrame(no_base + no_level + one_price + aliased, full.schema)
    got = {(r["respondent_id"], r["Level"]): r for r in rows(conjoint.respondent_part_worths(
        conjoint.respondent_coefficients(df, SURVEY), SURVEY))}
    # without the base the first level seen takes its place
    assert [got[("no_base", v)]["Utility"] for v in SURVEY_LEVELS["format"]] == pytest.approx([0.0, 0.0, -1.0, -3.0])
    assert got[("no_level", "Dark")]["Utility"] == 0.0 and got[("no_level", "Medium")]["Utility"] == pytest.approx(0.5)
    assert got[("one_price", "Price")]["Utility"] is None and got[("one_price", "Capsule")]["Utility"] == pytest.approx(2.0)
    # the later of two inseparable terms is unknown, and so is its whole attribute's centring
    assert got[("aliased", "Yes")]["Utility"] is None and got[("aliased", "No")]["Part_Worth"] is None
    assert got[("aliased", "Dark")]["Utility"] == pytest.approx(1.5 + 0.75)


def test_many_random_respondents_match_lstsq(spark, rows):
    rng = np.random.default_rng(9)
    data = []
    for who in range(40):
        for i in range(30):
            data.append((str(who), i, float(rng.integers(3, 7)), *[str(rng.choice(v)) for v in SURVEY_LEVELS.values()],
                         float(rng.normal())))
    columns = ["respondent_id", "productNo", "price", *SURVEY_LEVELS, "rating"]
    df = conjoint.prepare_ratings(spark.createDataFrame(data, columns), SURVEY)
    got = {r["respondent_id"]: r["coefficients"] for r in rows(conjoint.respondent_coefficients(df, SURVEY))}
    for who in range(40):
        mine = [d for d in data if d[0] == str(who)]
        design = np.array([[1.0, d[2], *[float(d[3 + k] == v) for k, vs in enumerate(SURVEY_LEVELS.values()) for v in vs[1:]]]
                           for d in mine])
        beta, _, rank, _ = np.linalg.lstsq(design, np.array([d[-1] for d in mine]), rcond=None)
        if rank == design.shape[1]:
            assert got[str(who)] == pytest.approx(beta[1:], abs=1e-8)


def test_infinite_wtp_and_trim(spark, rows):
    worths = spark.createDataFrame(
        [("a", "Price", "Price", 0.0, 0.0), ("a", "Origin", "x", 0.0, -0.5), ("a", "Origin", "y", 1.0, 0.5), ("a", "Origin", "z", 0.5, 0.0)],
        "respondent_id string, Attribute string, Level string, Utility double, Part_Worth double")
    got = {r["Level"]: r["WTP"] for r in rows(conjoint.respondent_wtp_joined(worths, SURVEY))}
    assert got == {"x": -math.inf, "y": math.inf, "z": None}


def test_shares(spark, rows):
    df = spark.createDataFrame([(f"p{i}", math.log(i)) for i in range(1, 5)], "Product string, Predicted_Utility double")
    shares = conjoint.logit_share(df)
    got = {r["Product"]: r["Predicted_Market_Share"] for r in rows(shares)}
    assert got == pytest.approx({"p1": 0.1, "p2": 0.2, "p3": 0.3, "p4": 0.4})
    gaps = conjoint.utility_gap(shares, "p4", -0.5)
    best = rows(conjoint.closest_competitor(gaps, "p4"))[0]
    assert best["Product"] == "p3" and best["WTP_Equivalent_Gap"] == pytest.approx(math.log(4 / 3) / 0.5)
    large = conjoint.logit_share(df.selectExpr("Product", "Predicted_Utility + 2000 AS Predicted_Utility"))
    assert {r["Product"]: r["Predicted_Market_Share"] for r in rows(large)} == pytest.approx(got)


def test_importance(spark, full, rows):
    fit = conjoint.pooled_fit(full, SURVEY)
    table = {r["Attribute"]: r for r in rows(conjoint.attribute_importance(conjoint.part_worths(spark, fit, SURVEY), full, SURVEY))}
    assert table["Price"]["Utility_Range"] == pytest.approx(1.25 * 3) and table["Format"]["Utility_Range"] == pytest.approx(3.0)
    assert sum(r["Importance"] for r in table.values()) == pytest.approx(1.0)


def test_a_dummy_is_one_comparison(spark, monkeypatch):
    data = [("r", 1, p, f, "Mild", "House blend", "No", r) for p, f, r in (
        (1.0, "Instant", 3.0), (2.0, "Capsule", 4.0), (None, "Ground", 5.0), (float("nan"), "Ground", 5.0),
        (3.0, None, 5.0), (3.0, "of a kind not listed", 5.0), (3.0, "Ground", None), (4.0, "Whole bean", 1.0))]
    raw = spark.createDataFrame(data, schemas.RATINGS)
    frames = []
    monkeypatch.setattr(conjoint, "written", lambda df: frames.append(df) or df)
    conjoint.respondent_coefficients(conjoint.prepare_ratings(raw, SURVEY), SURVEY)
    rows = [tuple(r)[1:] for r in frames[0].orderBy("x0").collect()]
    assert [r[0] for r in rows] == [1.0, 2.0, 4.0] and [r[-1] for r in rows] == [3.0, 4.0, 1.0]
    formats = [f"format{v}" for v in SURVEY.levels["format"][1:]]
    at = [SURVEY.terms.index(f) for f in formats]
    assert [sum(r[i] for i in at) for r in rows] == [0.0 if f == SURVEY.levels["format"][0] else 1.0 for f in ("Instant", "Capsule", "Whole bean")]
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" IN (") <= 4 * len(SURVEY.levels)  # per attribute, not per dummy and its test for nulls
