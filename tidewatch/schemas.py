"""Column layout of every stored table.

Counts are 64 bit: a hot topic can pass two billion mentions. Dates are zone-free
(`timestamp_ntz`, `date`), so results do not depend on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(),
    "double": DoubleType(), "boolean": BooleanType(), "date": DateType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Carries the order in which reviews arrived; "first copy wins" is defined by it.
SEQ = "ingest_seq"

REVIEW = _schema("""
    review_id string, review_text string, rating int, review_date timestamp_ntz,
    source_platform string, app_id string, app_name string, app_version string,
    helpful_count int""")

# A standardized review: the stored columns and its place in the input.
STANDARD = StructType([*REVIEW.fields, StructField(SEQ, LongType())])

CLEANED = _schema("""
    review_id string, review_text string, cleaned_text string, rating int,
    rating_bucket string, review_date timestamp_ntz, review_day date,
    review_week string, review_month string, review_year int,
    source_platform string, app_id string, app_name string, app_version string,
    helpful_count int, review_length bigint, word_count bigint""")

ISSUES = _schema("""
    review_id string, cluster_id int, issue_id string, issue_label string,
    issue_keywords string, cluster_size bigint, cluster_avg_rating double""")

ISSUE_CLUSTERS = _schema("""
    cluster_id int, issue_id string, issue_label string, issue_keywords string,
    cluster_size bigint, cluster_avg_rating double,
    representative_review_ids string""")

TRENDS = _schema("""
    issue_id string, date date, mention_count bigint, issue_share double,
    average_rating double, negative_share double, wow_change double,
    rolling_baseline double, rolling_std double, deviation_score double,
    growth_rate double, anomaly_flag boolean""")

SUMMARY = _schema("""
    issue_id string, issue_label string, latest_date date, latest_share double,
    previous_share double, recent_growth double, deviation_score double,
    average_rating double, negative_share double, mention_count bigint,
    total_mentions bigint, anomaly_flag boolean, risk_score double,
    risk_level string, confidence double, confidence_level string""")

IMPACT = _schema("""
    issue_id string, issue_label string, sample_size bigint, non_issue_size bigint,
    average_issue_rating double, average_non_issue_rating double,
    overall_rating double, median_issue_rating double,
    median_non_issue_rating double, rating_difference double,
    low_rating_share_issue double, low_rating_share_non_issue double,
    test_used string, test_reasoning string, p_value double, significant boolean,
    diff_ci_low double, diff_ci_high double, regression_effect double,
    regression_ci_low double, regression_ci_high double, regression_p double,
    reliable boolean, confidence_level string, interpretation string""")

PREDICTION = _schema("""
    issue_id string, issue_label string, n_periods bigint, horizon string,
    current_share double, recent_growth double, current_trend string,
    historical_rating_impact double, predicted_share double,
    predicted_rating_impact double, lower_bound double, upper_bound double,
    risk_level string, confidence_level string, reason_code string,
    explanation string""")


ISSUE_COUNTS = _schema("""
    date date, issue_id string, mention_count bigint, rating_sum bigint,
    rated_count bigint, negative_count bigint""")


@dataclass(frozen=True)
class Table:
    """A stored table; with `month_of`, the date whose month names the folder of a row."""

    schema: StructType
    key: tuple[str, ...] = ()
    month_column: str | None = None
    month_of: str | None = None


TABLES: dict[str, Table] = {
    "raw_reviews": Table(REVIEW, (), "stored_month", "review_date"),
    "cleaned_reviews": Table(CLEANED, ("review_id",), "review_month", "review_date"),
    "review_issues": Table(ISSUES, ("review_id",)),
    "issue_trends": Table(TRENDS, ("issue_id", "date"), "stored_month", "date"),
    "issue_summary": Table(SUMMARY, ("issue_id",)),
    "issue_impact": Table(IMPACT, ("issue_id",)),
    "issue_prediction": Table(PREDICTION, ("issue_id",)),
}

# Counts that streaming keeps to bring the series up to date; not part of a run's result.
STREAM_TABLES: dict[str, Table] = {
    "issue_counts": Table(ISSUE_COUNTS, ("date", "issue_id"), "stored_month", "date"),
}

ANALYTICAL_TABLES: tuple[str, ...] = tuple(t for t in TABLES if t != "raw_reviews")
