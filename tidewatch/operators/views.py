"""Read-side views over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import add, pick, sql
from tidewatch.functions.rounding import fixed, format_stars, round_exact
from tidewatch.operators.forecast import level_rank

EVIDENCE_COLUMNS = ("review_date", "rating", "source_platform", "review_text")
# Name shown for an issue.
_SHOWN = "coalesce(issue_label, issue_id)"


def monthly_rating(cleaned: DataFrame) -> DataFrame:
    """Mean rating per month and its change against the month before.

    The window runs over one row per month.
    """
    return sql(
        """
        SELECT *, rating - lag(rating, 1) OVER (ORDER BY review_month) AS delta
        FROM (SELECT review_month, avg(rating) AS rating FROM {cleaned}
              GROUP BY review_month)""", cleaned=cleaned)


def compute_kpis(cleaned: DataFrame, prediction: DataFrame,
                 summary: DataFrame) -> DataFrame:
    """One row of headline numbers. Without predictions the summary is counted.

    One pass per month feeds both the totals and the change of the last month.
    """
    rank = level_rank()
    return sql(
        f"""
        WITH months AS (
          SELECT review_month, count(*) AS n, count(rating) AS rated,
                 sum(rating) AS points, avg(rating) AS mean,
                 count_if(rating <= 2) AS negative
          FROM {{cleaned}} GROUP BY review_month),
        stepped AS (
          SELECT *, mean - lag(mean, 1) OVER (ORDER BY review_month) AS delta
          FROM months),
        reviews AS (
          SELECT coalesce(sum(n), 0) AS total, sum(points) / nullif(sum(rated), 0) AS mean,
                 100 * (sum(negative) / nullif(sum(n), 0)) AS negative,
                 max_by(delta, review_month) AS delta
          FROM stepped),
        counts AS (
          SELECT *,
            (SELECT struct(count(*) AS n, count_if({rank} >= 2) AS high,
                           count_if({rank} >= 1) AS emerging) FROM {{prediction}}) AS p,
            (SELECT struct(count_if(risk_level = 'HIGH') AS high,
                           count_if(anomaly_flag) AS emerging) FROM {{summary}}) AS s
          FROM reviews)
        SELECT total AS total_reviews, {round_exact('mean', 2)} AS avg_rating,
               {round_exact('delta', 2)} AS rating_trend_delta,
               {round_exact('negative', 1)} AS negative_pct,
               if(total > 0, p.n, 0) AS n_issues,
               if(total > 0, if(p.n > 0, p.emerging, s.emerging), 0) AS n_emerging,
               if(total > 0, if(p.n > 0, p.high, s.high), 0) AS n_high_risk
        FROM counts""", cleaned=cleaned, prediction=prediction, summary=summary)


def warning_ranked(prediction: DataFrame) -> DataFrame:
    """Predictions by tier, then by predicted impact; a missing impact counts as 0."""
    return prediction.orderBy(
        F.expr(level_rank()).desc(),
        F.expr("coalesce(predicted_rating_impact, 0.0D)").asc(), "issue_id")


def top_warnings(prediction: DataFrame, n: int = 4) -> DataFrame:
    """The leading warning and the next ones."""
    return warning_ranked(prediction).limit(n)


def risk_level_filter(prediction: DataFrame, levels: list[str]) -> DataFrame:
    return prediction.filter(F.col("risk_level").isin(*levels))


def representative_reviews(assignments: DataFrame, cleaned: DataFrame, issue_id: str,
                           n: int = 8) -> DataFrame:
    """Worst rated, then longest reviews of one issue, without identity columns."""
    mine = assignments.filter(F.col("issue_id") == issue_id).select("review_id")
    rows = mine.join(
        cleaned.select("review_id", "review_length", *EVIDENCE_COLUMNS), "review_id")
    return (rows.orderBy("rating", F.desc("review_length"), "review_id").limit(n)
            .select(*EVIDENCE_COLUMNS))


def evidence_top(assignments: DataFrame, cleaned: DataFrame, n: int = 8) -> DataFrame:
    """The same for every issue at once.

    Ranks are chosen before the texts are fetched, and Spark keeps only `n` rows per
    issue in each task ahead of the shuffle, so a hot issue stays small.
    """
    best = sql(
        f"""
        SELECT * FROM (
          SELECT review_id, issue_id, row_number() OVER (
            PARTITION BY issue_id ORDER BY rating, review_length DESC, review_id) AS rank
          FROM (SELECT review_id, issue_id FROM {{assignments}})
          JOIN (SELECT review_id, rating, review_length FROM {{cleaned}}) USING (review_id))
        WHERE rank <= {n}""", assignments=assignments, cleaned=cleaned)
    return best.join(cleaned.select("review_id", *EVIDENCE_COLUMNS), "review_id").select(
        "issue_id", "rank", *EVIDENCE_COLUMNS)


def impact_long(impact: DataFrame) -> DataFrame:
    """Mean rating with and without each issue, one row per bar."""
    bars = pick(impact, "issue_id", "average_issue_rating", "average_non_issue_rating",
                issue=_SHOWN).unpivot(
        ["issue_id", "issue"], ["average_issue_rating", "average_non_issue_rating"],
        "column", "rating")
    return bars.selectExpr(
        "issue_id", "issue",
        "CASE column WHEN 'average_issue_rating' THEN 'when issue present' "
        "ELSE 'when absent' END AS group", "rating")


def regression_bars(impact: DataFrame) -> DataFrame:
    """Adjusted effect with the lengths of its two error bars."""
    return pick(
        impact.filter("regression_effect IS NOT NULL"), "issue_id",
        issue=_SHOWN, regression_effect="regression_effect",
        plus="regression_ci_high - regression_effect",
        minus="regression_effect - regression_ci_low")


def impact_display(prediction: DataFrame) -> DataFrame:
    """Impact to show per issue and what it is based on."""
    df = add(prediction, burden="current_share * historical_rating_impact")
    return pick(
        df, "issue_id",
        impact_text=f"""CASE
            WHEN predicted_rating_impact IS NOT NULL
              THEN {format_stars('predicted_rating_impact')}
            WHEN burden IS NOT NULL THEN concat({format_stars('burden')}, ' now')
            ELSE 'Not enough data' END""",
        basis="""CASE WHEN predicted_rating_impact IS NOT NULL THEN 'forecast'
            WHEN burden IS NOT NULL THEN 'current burden' ELSE 'none' END""")


def display_table(prediction: DataFrame) -> DataFrame:
    """Ranked table of emerging issues; shares and growth in percent."""
    return pick(
        warning_ranked(prediction), "issue_id",
        issue=_SHOWN, risk="risk_level", confidence="confidence_level",
        current_share_pct="current_share * 100", growth_pct="recent_growth * 100",
        historical_impact="historical_rating_impact",
        predicted_impact="predicted_rating_impact",
        ci_low="lower_bound", ci_high="upper_bound")


def issue_keywords(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("issue_id").agg(
        F.min("issue_keywords").alias("issue_keywords"))


def issue_gloss(assignments: DataFrame, impact: DataFrame) -> DataFrame:
    """Plain-language description of every assigned issue."""
    lead = f"""concat_ws(', ',
        CASE WHEN sample_size > 0
          THEN concat('Grouped from **', sample_size, ' complaint reviews**') END,
        concat('averaging **', {fixed('average_issue_rating', 1)}, '★**'),
        concat('**', {fixed('(low_rating_share_issue * 100)', 0)}, '%** of them rated 1–2★'))"""
    terms = ("slice(filter(transform(split(coalesce(issue_keywords, ''), ','), "
             "t -> trim(t)), t -> t <> ''), 1, 6)")
    described = issue_keywords(assignments).join(
        impact.select("issue_id", "sample_size", "average_issue_rating",
                      "low_rating_share_issue"), "issue_id", "left")
    parts = pick(described, "issue_id", lead=lead, terms=terms)
    parts = add(parts, tail="concat('Users most often mention: ', array_join("
                            "transform(terms, t -> concat('*', t, '*')), ', '), '.')")
    return pick(
        parts, "issue_id",
        gloss="""CASE WHEN size(terms) > 0 AND lead <> '' THEN concat(lead, '. ', tail)
            WHEN size(terms) > 0 THEN tail WHEN lead <> '' THEN concat(lead, '.')
            ELSE 'Representative complaints are shown below.' END""")
