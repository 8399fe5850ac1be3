"""Explainable early-warning score of every issue at the latest period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import add, sql
from tidewatch.functions.rounding import round_columns
from tidewatch.operators.trends import issue_labels
from tidewatch.params import TrendParams
from tidewatch.schemas import SUMMARY

SUMMARY_DIGITS = {
    "latest_share": 4, "previous_share": 4, "recent_growth": 4, "deviation_score": 3,
    "average_rating": 3, "negative_share": 3, "risk_score": 1, "confidence": 3,
}


def level(value: str, high: float, medium: float) -> str:
    return (f"CASE WHEN {value} >= {high}D THEN 'HIGH' WHEN {value} >= {medium}D "
            "THEN 'MEDIUM' ELSE 'LOW' END")


def clip01(x: str) -> str:
    return f"least(greatest({x}, 0.0D), 1.0D)"


def latest_rows(trends: DataFrame) -> DataFrame:
    """Last row of every issue plus its previous share and total mentions."""
    return sql(
        """
        SELECT * FROM (
          SELECT *, lag(issue_share, 1) OVER (PARTITION BY issue_id ORDER BY date)
                      AS previous_share,
                 sum(mention_count) OVER (PARTITION BY issue_id) AS total_mentions,
                 max(date) OVER (PARTITION BY issue_id) AS last_date
          FROM {trends})
        WHERE date = last_date""", trends=trends)


def risk_signals(p: TrendParams) -> dict[str, str]:
    """The five inputs of the score, each on a scale from 0 to 1."""
    rating = clip01("(5 - average_rating) / 4")
    return {
        "s_growth": clip01(f"growth_rate / {p.growth_cap}D"),
        "s_deviation": clip01(f"deviation_score / {p.z_cap}D"),
        # Without a mention there is no rating and no pressure from it.
        "s_rating": f"CASE WHEN average_rating IS NULL THEN 0.0D ELSE {rating} END",
        "s_negative": "coalesce(negative_share, 0.0D)",
        "s_volume": clip01(f"mention_count / {p.volume_cap}D"),
    }


def score_issues(trends: DataFrame, labels: DataFrame | None = None,
                 params: TrendParams = TrendParams(), rounded: bool = True) -> DataFrame:
    """One row per issue present at the latest period, ranked by risk.

    Levels are set on the unrounded values. Without `labels` the label is NULL.
    """
    p = params
    snap = sql("SELECT * FROM {last} WHERE date = (SELECT max(date) FROM {trends})",
               last=latest_rows(trends), trends=trends)
    snap = add(snap, **risk_signals(p))
    if labels is None:
        snap = add(snap, issue_label="CAST(NULL AS STRING)")
    else:
        snap = snap.join(issue_labels(labels), "issue_id", "left")
    scored = add(
        snap,
        risk_score=f"100 * ({p.w_growth}D * s_growth + {p.w_deviation}D * s_deviation "
                   f"+ {p.w_rating}D * s_rating + {p.w_negative}D * s_negative "
                   f"+ {p.w_volume}D * s_volume)",
        confidence=clip01(f"total_mentions / {p.confidence_cap}D"),
    ).selectExpr(
        "issue_id", "issue_label", "date AS latest_date", "issue_share AS latest_share",
        "previous_share", "growth_rate AS recent_growth", "deviation_score",
        "average_rating", "s_negative AS negative_share", "mention_count",
        "total_mentions", "anomaly_flag", "risk_score", "confidence",
        f"{level('risk_score', p.risk_high, p.risk_medium)} AS risk_level",
        f"{level('confidence', p.confidence_high, p.confidence_medium)} AS confidence_level",
    )
    if rounded:
        scored = round_columns(scored, SUMMARY_DIGITS)
    return (scored.select(*SUMMARY.fieldNames())
            .orderBy(F.desc("risk_score"), "issue_id"))
