import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import ASSIGNED_DDL, REVIEW_DDL, rows, weekly

from tidewatch.operators.forecast import (
    backtest,
    backtest_windows,
    forecast_share,
    predict_rating_risk,
)
from tidewatch.operators.impact import compute_issue_impact
from tidewatch.operators.trends import build_issue_trends
from tidewatch.params import ForecastParams, ImpactParams
from tidewatch.schemas import IMPACT, PREDICTION

DAY0 = datetime(2026, 6, 1)


def dataset(spark, groups):
    """groups: issue (or None) -> list of (rating, length, day)."""
    reviews, assigned = [], []
    for issue, members in groups.items():
        for i, (rating, length, day) in enumerate(members):
            rid = f"{issue}_{i}"
            reviews.append((rid, DAY0 + timedelta(days=day, hours=i % 24), rating, length))
            if issue is not None:
                assigned.append((rid, issue, f"{issue} label"))
    return (spark.createDataFrame(reviews, REVIEW_DDL),
            spark.createDataFrame(assigned, ASSIGNED_DDL))


def harmful():
    return {
        "bad": [(1 + i % 2, 40 + i % 10, i % 40) for i in range(60)],
        "good": [(4 + i % 2, 30 + (i * 7) % 10, (60 + i) % 40) for i in range(60)],
    }


def mixed():
    return {
        "a": [(1 + (i * i) % 4, 20 + (i * 13) % 31, (i * 5) % 60) for i in range(70)],
        "b": [(1 + (i * 3) % 5, 25 + (i * 17) % 23, (i * 11) % 45) for i in range(35)],
        "c": [(2 + i % 2, 10 + i, i) for i in range(6)],
        None: [(3 + i % 3, 30 + (i * 5) % 40, (i * 3) % 70) for i in range(90)],
    }


def brute_force(groups, issue):
    """Row-level regression with HC3 errors and a rank test by pairwise comparison."""
    data, first = [], min(
        DAY0 + timedelta(days=d, hours=i % 24)
        for g in groups.values() for i, (_, _, d) in enumerate(g))
    for name, members in groups.items():
        for i, (rating, length, day) in enumerate(members):
            elapsed = DAY0 + timedelta(days=day, hours=i % 24) - first
            data.append((rating, name == issue, length, elapsed.days // 7))
    y = np.array([d[0] for d in data], float)
    x = np.array([[1, d[1], d[2], d[3]] for d in data], float)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    lever = np.einsum("ij,jk,ik->i", x, inv, x)
    scaled = ((y - x @ beta) / (1 - lever)) ** 2
    cov = inv @ (x.T * scaled) @ x @ inv
    own, rest = y[x[:, 1] == 1], y[x[:, 1] == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in own for b in rest)
    n1, n2 = len(own), len(rest)
    _, ties = np.unique(y, return_counts=True)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - (ties**3 - ties).sum() / (n * (n - 1))))
    z = (max(wins, n1 * n2 - wins) - n1 * n2 / 2 - 0.5) / sd
    return beta[1], math.sqrt(cov[1, 1]), min(1, math.erfc(z / math.sqrt(2))), own, rest


@pytest.mark.parametrize("chunk", [256, 1])
def test_against_brute_force(spark, chunk):
    groups = mixed()
    out = rows(compute_issue_impact(*dataset(spark, groups), ImpactParams(issue_chunk=chunk),
                                    rounded=False), "issue_id")
    assert set(out) == {"a", "b", "c"}
    for issue, r in out.items():
        beta, se, p, own, rest = brute_force(groups, issue)
        assert r["sample_size"] == len(own) and r["non_issue_size"] == len(rest)
        assert r["regression_effect"] == pytest.approx(beta, abs=1e-9)
        assert r["regression_ci_high"] - beta == pytest.approx(1.959963985 * se, abs=1e-8)
        assert r["regression_p"] == pytest.approx(math.erfc(abs(beta / se) / 2**0.5), abs=1e-9)
        assert r["test_used"] == "mann_whitney_u" and r["p_value"] == pytest.approx(p)
        assert r["median_issue_rating"] == np.median(own)
        assert r["median_non_issue_rating"] == np.median(rest)
        assert r["rating_difference"] == pytest.approx(own.mean() - rest.mean())
        assert r["diff_ci_low"] < r["rating_difference"] < r["diff_ci_high"]


def test_harmful_issue(spark):
    out = compute_issue_impact(*dataset(spark, harmful()))
    assert out.columns == IMPACT.fieldNames()
    first = rows(out)[0]
    assert first["issue_id"] == "bad" and first["issue_label"] == "bad label"
    assert first["rating_difference"] < 0 and first["regression_effect"] < 0
    assert first["significant"] and first["test_used"] == "mann_whitney_u"
    assert "lower ratings" in first["interpretation"]
    assert "association, not causation" in first["interpretation"]
    assert first["diff_ci_low"] <= first["diff_ci_high"]


def test_small_sample_is_unreliable(spark):
    groups = {"tiny": [(1 + i % 2, 20, i) for i in range(6)],
              "big": [(4, 20, i) for i in range(40)]}
    tiny = rows(compute_issue_impact(*dataset(spark, groups)), "issue_id")["tiny"]
    assert tiny["reliable"] is False and tiny["confidence_level"] == "low"
    assert "reliable estimate" in tiny["interpretation"]


def test_too_small_for_a_test_and_alone(spark):
    few = rows(compute_issue_impact(*dataset(
        spark, {"x": [(1, 5, 0)] * 3, None: [(4, 5, 0)] * 20})), "issue_id")["x"]
    assert few["test_used"] == "none" and few["p_value"] is None
    assert few["diff_ci_low"] == few["diff_ci_high"] == -3.0
    alone = rows(compute_issue_impact(*dataset(spark, {"x": [(2, 5, 0)] * 40})))[0]
    assert alone["non_issue_size"] == 0 and alone["rating_difference"] is None
    assert alone["regression_effect"] is None


def test_welch_needs_two_normal_groups(spark):
    bell = [1] * 2 + [2] * 6 + [3] * 9 + [4] * 6 + [5] * 2
    groups = {"n": [(r, 10 + i % 5, i) for i, r in enumerate(bell)],
              None: [(r, 10 + i % 3, i) for i, r in enumerate(bell)]}
    out = rows(compute_issue_impact(*dataset(spark, groups)))[0]
    assert out["test_used"] == "welch_t" and out["p_value"] == 1.0


def test_empty_impact(spark):
    out = compute_issue_impact(spark.createDataFrame([], REVIEW_DDL),
                               spark.createDataFrame([], ASSIGNED_DDL))
    assert out.columns == IMPACT.fieldNames() and out.count() == 0


# --- forecast ------------------------------------------------------------------------

def series(spark, shares, issue="x"):
    return spark.createDataFrame(
        [(issue, date(2026, 6, 1) + timedelta(days=7 * i), s) for i, s in enumerate(shares)],
        "issue_id string, date date, issue_share double")


def test_exact_line(spark):
    got = rows(forecast_share(series(spark, [0.10, 0.15, 0.20, 0.25, 0.30])))[0]
    assert got["slope"] == pytest.approx(0.05) and got["predicted"] == pytest.approx(0.40)
    assert got["low"] == pytest.approx(0.40, abs=1e-6)
    assert got["low"] <= got["predicted"] <= got["high"]


def test_prediction_interval_by_hand(spark):
    y = np.array([0.2, 0.1, 0.35, 0.3, 0.5, 0.4])
    got = rows(forecast_share(series(spark, y.tolist())))[0]
    x = np.arange(6)
    slope, icpt = np.polyfit(x, y, 1)
    s = math.sqrt(((y - icpt - slope * x) ** 2).sum() / 4)
    half = 2.7764451052 * s * math.sqrt(1 + 1 / 6 + (7 - 2.5) ** 2 / 17.5)
    assert got["predicted"] == pytest.approx(icpt + slope * 7)
    assert got["high"] == pytest.approx(min(1, icpt + slope * 7 + half))
    assert rows(forecast_share(series(spark, [0.1, 0.2])))[0]["predicted"] is None


def rising(weeks):
    return [round(1 + 15 * i / (weeks - 1)) for i in range(weeks)]


def stages(spark, weeks, bad=None):
    reviews, assigned = weekly(
        spark, {"bad": bad or rising(weeks), "ok": [6] * weeks},
        {"bad": [1, 2], "ok": [4, 5]}, start=datetime(2026, 5, 1), lengths={"bad": 60})
    return (build_issue_trends(reviews, assigned).cache(),
            compute_issue_impact(reviews, assigned).cache())


@pytest.fixture(scope="module")
def twelve(spark):
    return stages(spark, 12)


def test_rising_harmful_issue_is_a_risk(twelve):
    out = predict_rating_risk(*twelve)
    assert out.columns == PREDICTION.fieldNames()
    first = rows(out)[0]
    assert first["issue_id"] == "bad" and first["current_trend"] == "rising"
    assert first["historical_rating_impact"] < 0 and first["predicted_rating_impact"] < 0
    assert first["lower_bound"] <= first["upper_bound"]
    assert first["risk_level"] in ("MEDIUM", "HIGH", "CRITICAL")
    assert first["explanation"].startswith("Risk is") and "because" in first["explanation"]
    assert rows(out, "issue_id")["ok"]["risk_level"] == "LOW"
    assert rows(out, "issue_id")["ok"]["reason_code"] == "no_negative_pressure"


def test_without_impact_there_is_no_penalty(spark, twelve):
    out = rows(predict_rating_risk(twelve[0], spark.createDataFrame([], IMPACT)))
    assert {r["reason_code"] for r in out} == {"no_historical_impact"}
    assert {r["risk_level"] for r in out} == {"LOW"}


def test_short_history_uses_current_burden(spark):
    row = rows(predict_rating_risk(*stages(spark, 3, [10, 10, 10])), "issue_id")["bad"]
    assert row["predicted_rating_impact"] is None and row["confidence_level"] == "low"
    assert row["reason_code"] == "current_burden"
    assert row["risk_level"] in ("MEDIUM", "HIGH", "CRITICAL")
    assert "current" in row["explanation"] and "drag" in row["explanation"]


def test_backtest(spark, twelve):
    report = rows(backtest(*twelve))[0]
    assert report["n_backtests"] == 2 * 7 and report["note"] is None
    assert 0 <= report["directional_accuracy"] <= 1 and 0 <= report["interval_coverage"] <= 1
    windows = rows(backtest_windows(twelve[0]))
    assert {w["penalty"] for w in windows} == {None}
    one = next(w for w in windows if w["issue_id"] == "bad" and w["n"] == 6)
    shares = [r["issue_share"] for r in sorted(
        (r for r in rows(twelve[0]) if r["issue_id"] == "bad"), key=lambda r: r["date"])]
    slope, icpt = np.polyfit(np.arange(6), shares[:6], 1)
    assert one["predicted"] == pytest.approx(min(1, icpt + slope * 7))
    assert one["actual"] == pytest.approx(shares[7])


def test_backtest_without_windows(twelve):
    report = rows(backtest(*twelve, ForecastParams(horizon=20)))[0]
    assert report["n_backtests"] == 0 and "Insufficient" in report["note"]
    few = rows(backtest(*twelve, ForecastParams(min_fit=9)))[0]
    assert 0 < few["n_backtests"] < 10 and "indicative" in few["limitations"]
