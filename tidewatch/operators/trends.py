"""Issue time series with rolling baselines, growth and anomaly flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import add, ratio, sql
from tidewatch.params import TrendParams
from tidewatch.schemas import TRENDS

_TRUNC = {"W": "week", "D": None, "M": "month"}
UNITS = {"W": "weeks", "D": "days", "M": "months"}


def period(date: str, freq: str) -> str:
    """First day of the week (Monday), day or month a timestamp falls in, as SQL text."""
    if freq not in _TRUNC:
        raise ValueError(f"unknown frequency {freq!r}; expected one of {sorted(_TRUNC)}")
    day, unit = f"CAST({date} AS DATE)", _TRUNC[freq]
    return f"trunc({day}, '{unit}')" if unit else day


def period_totals(cleaned: DataFrame, freq: str = "W") -> DataFrame:
    """Number of reviews in every period that has any."""
    return sql(
        f"""
        SELECT {period('review_date', freq)} AS date, count(*) AS total_reviews
        FROM {{cleaned}} WHERE review_date IS NOT NULL GROUP BY 1""", cleaned=cleaned)


def issue_period_stats(cleaned: DataFrame, assignments: DataFrame,
                       freq: str = "W") -> DataFrame:
    """Mentions, mean rating and negative share per issue and observed period."""
    return sql(
        f"""
        SELECT issue_id, {period('review_date', freq)} AS date,
               count(*) AS mention_count,
               avg(CAST(rating AS DOUBLE)) AS average_rating,
               avg(CAST(coalesce(rating <= 2, false) AS DOUBLE)) AS negative_share
        FROM (SELECT review_id, issue_id FROM {{assignments}} WHERE issue_id IS NOT NULL)
        JOIN (SELECT review_id, review_date, rating FROM {{cleaned}}
              WHERE review_date IS NOT NULL)
        USING (review_id)
        GROUP BY 1, 2""", assignments=assignments, cleaned=cleaned)


def issue_grid(issue_periods: DataFrame, totals: DataFrame) -> DataFrame:
    """Every issue in every observed period.

    Each issue unrolls the list of observed periods and an equi-join adds their totals,
    so periods without any review are absent, a stray far date adds one period only, and
    no cross join is planned. The list has one entry per observed period.
    """
    return sql(
        f"""
        SELECT issue_id, date, total_reviews
        FROM (SELECT issue_id, explode((SELECT collect_set(date) FROM {{totals}})) AS date
              FROM (SELECT DISTINCT issue_id FROM {{periods}}))
        JOIN {{totals}} USING (date)""", totals=totals, periods=issue_periods)


def series_metrics(grid: DataFrame, p: TrendParams) -> DataFrame:
    """Share based metrics of a dense series; rows count as time steps."""
    full = f"count(issue_share) OVER past >= {p.min_baseline}"
    stepped = sql(
        f"""
        SELECT *,
          lag(issue_share, 1) OVER series AS previous,
          lag(issue_share, {p.growth_lookback}) OVER series AS prior,
          CASE WHEN {full} THEN avg(issue_share) OVER past END AS baseline,
          CASE WHEN {full} THEN stddev_samp(issue_share) OVER past END AS spread
        FROM {{grid}}
        WINDOW series AS (PARTITION BY issue_id ORDER BY date),
               past AS (PARTITION BY issue_id ORDER BY date
                        ROWS BETWEEN {p.rolling_periods} PRECEDING AND 1 PRECEDING)""",
        grid=grid)
    scored = add(
        stepped,
        wow_change="coalesce(issue_share - previous, 0.0D)",
        rolling_baseline="coalesce(baseline, 0.0D)",
        rolling_std="coalesce(spread, 0.0D)",
        z=ratio("issue_share - baseline", "spread"),
        growth_rate=f"coalesce(CASE WHEN prior = 0 AND issue_share > 0 THEN {p.growth_cap}D "
                    f"ELSE {ratio('issue_share - prior', 'prior')} END, 0.0D)",
    )
    return add(
        scored,
        deviation_score="coalesce(z, 0.0D)",
        anomaly_flag=f"coalesce(z >= {p.anomaly_z}D AND mention_count >= {p.min_mentions}, "
                     "false)",
    )


def build_issue_trends(cleaned: DataFrame, assignments: DataFrame,
                       params: TrendParams = TrendParams()) -> DataFrame:
    """One row per issue and observed period.

    The share of an issue is its mentions over all reviews of the period, so reviews
    without an issue count in the denominator. Mean rating and negative share stay NULL
    in periods without a mention.
    """
    totals = period_totals(cleaned, params.freq)
    stats = issue_period_stats(cleaned, assignments, params.freq)
    grid = sql(
        """
        SELECT issue_id, date, coalesce(mention_count, 0) AS mention_count,
               coalesce(mention_count, 0) / total_reviews AS issue_share,
               average_rating, negative_share
        FROM {cells} LEFT JOIN {stats} USING (issue_id, date)""",
        cells=issue_grid(stats, totals), stats=stats)
    return series_metrics(grid, params).select(*TRENDS.fieldNames())


def anomaly_points(trends: DataFrame, issue_ids: list[str] | None = None) -> DataFrame:
    """Flagged points of all or of the selected issues."""
    points = trends.filter("anomaly_flag")
    if issue_ids is not None:
        points = points.filter(F.col("issue_id").isin(*issue_ids))
    return points


def as_of_date(trends: DataFrame) -> DataFrame:
    return trends.agg(F.max("date").alias("as_of_date"))


def issue_labels(assignments: DataFrame) -> DataFrame:
    """One label per issue; NULL where assignments carry no labels."""
    if "issue_label" in assignments.columns:
        label = F.min("issue_label")
    else:
        label = F.min(F.lit(None).cast("string"))
    return (assignments.filter(F.col("issue_id").isNotNull())
            .groupBy("issue_id").agg(label.alias("issue_label")))
