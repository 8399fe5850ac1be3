from datetime import date, datetime

import pytest
from helpers import ASSIGNED_DDL, REVIEW_DDL, rows, weekly

from tidewatch.operators.risk import score_issues
from tidewatch.operators.trends import anomaly_points, as_of_date, build_issue_trends, period
from tidewatch.params import TrendParams
from tidewatch.schemas import SUMMARY, TRENDS

COUNTS = {"stable": [5] * 8, "rising": [1, 1, 1, 1, 2, 4, 8, 14]}


@pytest.fixture(scope="module")
def trends(spark):
    reviews, assigned = weekly(spark, COUNTS, {"stable": [4], "rising": [1]})
    return build_issue_trends(reviews, assigned).cache(), assigned


def test_grid_is_complete_and_shares_add_up(trends):
    series = rows(trends[0])
    assert trends[0].columns == TRENDS.fieldNames()
    assert len(series) == 16 and len({r["date"] for r in series}) == 8
    for day in {r["date"] for r in series}:
        assert sum(r["issue_share"] for r in series if r["date"] == day) == pytest.approx(1)
    assert rows(as_of_date(trends[0]))[0]["as_of_date"] == date(2026, 7, 20)


def test_rising_issue_is_flagged_and_stable_is_not(trends):
    flagged = rows(anomaly_points(trends[0]))
    assert flagged and {r["issue_id"] for r in flagged} == {"rising"}
    assert anomaly_points(trends[0], ["stable"]).count() == 0


def test_metrics_by_hand(trends):
    import statistics
    series = sorted((r for r in rows(trends[0]) if r["issue_id"] == "rising"),
                    key=lambda r: r["date"])
    share = [n / (n + 5) for n in COUNTS["rising"]]
    for i, r in enumerate(series):
        past = share[max(0, i - 4):i]
        base = statistics.mean(past) if len(past) >= 2 else 0
        sd = statistics.stdev(past) if len(past) >= 2 else 0
        assert r["issue_share"] == pytest.approx(share[i])
        assert r["wow_change"] == pytest.approx(share[i] - share[i - 1] if i else 0)
        assert r["rolling_baseline"] == pytest.approx(base)
        assert r["rolling_std"] == pytest.approx(sd)
        z = (share[i] - base) / sd if sd > 1e-12 else 0
        assert r["deviation_score"] == pytest.approx(z)
        assert r["growth_rate"] == pytest.approx(
            share[i] / share[i - 2] - 1 if i >= 2 else 0)


def test_summary_ranks_the_rising_issue_first(trends):
    summary = score_issues(trends[0], trends[1])
    assert summary.columns == SUMMARY.fieldNames()
    top, other = rows(summary)
    assert top["issue_id"] == "rising" and top["issue_label"] == "rising label"
    assert top["risk_level"] in ("HIGH", "MEDIUM")
    assert top["risk_score"] > other["risk_score"]
    assert 0 <= other["confidence"] <= 1
    assert {r["issue_label"] for r in rows(score_issues(trends[0]))} == {None}


def test_empty_inputs(spark):
    empty = build_issue_trends(spark.createDataFrame([], REVIEW_DDL),
                               spark.createDataFrame([], ASSIGNED_DDL))
    assert empty.count() == 0 and score_issues(empty).count() == 0


def test_calendar_gap_emergence_and_silent_issue(spark):
    """A week without any review is absent; growth from zero is capped growth."""
    weeks = [1, 8, 22, 29]  # no review in the week of the 15th
    reviews = [(f"o{d}", datetime(2026, 6, d, 23, 59), 4, 1) for d in weeks]
    reviews += [("x", datetime(2026, 6, 29), None, 1), ("y", datetime(2026, 6, 1), 2, 1)]
    assigned = [(f"o{d}", "old", None) for d in weeks] + [("x", "new", None),
                                                         ("y", "gone", None)]
    series = rows(build_issue_trends(spark.createDataFrame(reviews, REVIEW_DDL),
                                     spark.createDataFrame(assigned, ASSIGNED_DDL)))
    dates = sorted({r["date"] for r in series})
    assert dates == [date(2026, 6, d) for d in weeks]
    new = {r["date"]: r for r in series if r["issue_id"] == "new"}
    assert new[dates[0]]["average_rating"] is None and new[dates[0]]["mention_count"] == 0
    assert new[dates[3]]["growth_rate"] == 1.0 and new[dates[3]]["deviation_score"] == 0
    assert new[dates[3]]["average_rating"] is None and new[dates[3]]["negative_share"] == 0
    summary = rows(score_issues(build_issue_trends(
        spark.createDataFrame(reviews, REVIEW_DDL),
        spark.createDataFrame(assigned, ASSIGNED_DDL))), "issue_id")
    assert summary["gone"]["risk_score"] == 0 and summary["gone"]["average_rating"] is None
    assert summary["new"]["total_mentions"] == 1


@pytest.mark.parametrize("freq,expected", [("W", "2026-08-10"), ("D", "2026-08-16"),
                                           ("M", "2026-08-01")])
def test_periods(spark, freq, expected):
    sql = f"SELECT {period('d', freq)} FROM (SELECT TIMESTAMP_NTZ '2026-08-16 10:00:00' AS d)"
    assert str(spark.sql(sql).first()[0]) == expected


def test_unknown_frequency():
    with pytest.raises(ValueError):
        period("d", "Q")


def test_parameters_are_used(spark):
    reviews, assigned = weekly(spark, COUNTS, {"stable": [4], "rising": [1]})
    strict = build_issue_trends(reviews, assigned, TrendParams(min_mentions=1000))
    assert anomaly_points(strict).count() == 0
