"""Named queries over the shared test tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import add
from tidewatch.functions.rounding import format_percent, format_stars
from tidewatch.operators import clean, forecast, impact, issues, labels, risk, textfeat
from tidewatch.operators import trends, validate, views
from tidewatch.operators.cluster import cluster_vectors
from tidewatch.params import ForecastParams, ImpactParams, TextParams, TrendParams
from tidewatch.plans import derived
from tidewatch.plans.lineage import cut_lineage, ensure_checkpoint_dir, write_table
from tidewatch.schemas import REVIEW, SEQ
from tidewatch.sources.native import (
    APP_STORE,
    GOOGLE_PLAY,
    Source,
    stack_sources,
    standardize_app_store,
    standardize_google_play,
)
from tidewatch.sources.store import ReviewStore
from tidewatch.streaming.counts import trends_stream
from tidewatch.streaming.ingest import ingest_stream

# The events span thirty days, so daily periods give the longest series.
DAILY = TrendParams(freq="D")
WEEKLY = TrendParams(freq="W")
DAILY_FORECAST = ForecastParams(freq="D")
IMPACT = ImpactParams()
TEXT = TextParams()

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to a fixed number of decimals: the last bits of a sum depend on its order."""
    return df.selectExpr(*[
        f"round({n}, {digits}) AS {n}" if t == "double" else n for n, t in df.dtypes])


# --- ingest, validation, cleaning ----------------------------------------------------

def google_play(spark, folder):
    native = derived.google_play_native(spark, folder)
    return standardize_google_play(native, derived.APP_ID, derived.APP_NAME)


def app_store(spark, folder):
    native = derived.app_store_native(spark, folder)
    return standardize_app_store(native, derived.STORE_APP_ID, derived.APP_NAME)


def stacked(spark, folder):
    sources = [Source(GOOGLE_PLAY, derived.APP_ID, derived.APP_NAME,
                      native=derived.google_play_native(spark, folder)),
               Source(APP_STORE, derived.STORE_APP_ID, derived.APP_NAME,
                      native=derived.app_store_native(spark, folder))]
    return (stack_sources(spark, sources)
            .groupBy("source_platform", "app_id", "rating")
            .agg(F.count(F.lit(1)).alias("reviews"),
                 F.count("review_date").alias("dated"),
                 F.count("app_version").alias("versioned"),
                 F.count_distinct("review_id").alias("ids"),
                 F.min(SEQ).alias("first_seq"), F.max(SEQ).alias("last_seq")))


def flags(spark, folder):
    rows = validate.flag_reviews(derived.dirty_reviews(spark, folder))
    return rows.select(SEQ, "review_id", *validate.FLAGS, "dropped")


def validated(spark, folder):
    return validate.valid_reviews(derived.dirty_reviews(spark, folder))


def report(spark, folder):
    return clean.cleaning_report(derived.dirty_reviews(spark, folder))


def cleaned_text(spark, folder):
    rows = clean.with_clean_text(derived.document_reviews(spark, folder))
    return clean.add_features(rows).select(
        "review_id", "cleaned_text", "review_length", "word_count")


def cleaned_features(spark, folder):
    return clean.build_cleaned(derived.dirty_reviews(spark, folder))


def quality(spark, folder):
    raw = derived.dirty_reviews(spark, folder).select(*REVIEW.fieldNames())
    return clean.data_quality(raw, "raw_reviews")


# --- series, score -------------------------------------------------------------------

def _inputs(spark, folder):
    reviews = derived.event_reviews(spark, folder)
    return reviews, derived.event_assignments(reviews)


def period_totals(spark, folder):
    return trends.period_totals(derived.event_reviews(spark, folder), "D")


def period_stats(spark, folder):
    return rounded(trends.issue_period_stats(*_inputs(spark, folder), "D"))


def _trends(spark, folder, params=DAILY):
    """The series, written once: later steps read it more than once."""
    return cut_lineage(trends.build_issue_trends(*_inputs(spark, folder), params))


def issue_trends(spark, folder, params):
    return rounded(trends.build_issue_trends(*_inputs(spark, folder), params))


def anomalies(spark, folder):
    return rounded(trends.anomaly_points(_trends(spark, folder)))


def _summary(spark, folder, exact=False):
    _, assigned = _inputs(spark, folder)
    return risk.score_issues(_trends(spark, folder), assigned, DAILY, rounded=not exact)


def issue_summary(spark, folder):
    return _summary(spark, folder)


def risk_scores(spark, folder):
    return rounded(_summary(spark, folder, exact=True).select(
        "issue_id", "risk_score", "confidence", "recent_growth", "deviation_score"))


# --- impact --------------------------------------------------------------------------

def _cells(spark, folder):
    return cut_lineage(impact.rating_cells(*_inputs(spark, folder)))


def group_stats(spark, folder):
    df = impact.group_stats(_cells(spark, folder), IMPACT)
    return rounded(df.select(
        "issue_id", "n1", "n2", "mean1", "mean2", "overall", "median1", "median2",
        "diff", "low1", "low2", "var1", "var2"))


def welch(spark, folder):
    df = impact.welch_parts(impact.group_stats(_cells(spark, folder), IMPACT))
    return rounded(df.select("issue_id", "diff", "se", "dof"), 6)


def mann_whitney(spark, folder):
    df = impact.rank_parts(impact.group_stats(_cells(spark, folder), IMPACT))
    return rounded(df.select("issue_id", "u1", "sigma", "z"), 6)


def hc3(spark, folder):
    cells = _cells(spark, folder)
    df = impact.regress(cells, impact.group_stats(cells, IMPACT), IMPACT)
    return rounded(df.select("issue_id", "effect", "effect_se", "effect_low",
                             "effect_high"))


def impact_table(spark, folder):
    return impact.compute_issue_impact(*_inputs(spark, folder), IMPACT)


def _impact(spark, folder):
    """The stored form of the impact table."""
    return cut_lineage(impact_table(spark, folder))


def impact_p_values(spark, folder):
    full = impact.compute_issue_impact(*_inputs(spark, folder), IMPACT, rounded=False)
    return full.select("issue_id", "test_used", "p_value", "regression_p",
                       "diff_ci_low", "diff_ci_high")


# --- forecast ------------------------------------------------------------------------

def share_forecast(spark, folder):
    return rounded(forecast.forecast_share(_trends(spark, folder), DAILY_FORECAST))


def penalty_choice(spark, folder):
    return forecast.penalties(_impact(spark, folder), DAILY_FORECAST)


def rating_risk(spark, folder):
    return forecast.predict_rating_risk(
        _trends(spark, folder), _impact(spark, folder), DAILY_FORECAST)


def _prediction(spark, folder):
    """The stored form of the prediction table."""
    return cut_lineage(rating_risk(spark, folder))


def burden_risk(spark, folder):
    """Without enough history the current burden takes the forecast's place."""
    return forecast.predict_rating_risk(
        _trends(spark, folder), _impact(spark, folder),
        replace(DAILY_FORECAST, min_history=10**6))


def backtest_windows(spark, folder):
    rows = forecast.backtest_windows(
        _trends(spark, folder), _impact(spark, folder), DAILY_FORECAST)
    return rounded(rows)


def backtest_report(spark, folder):
    return forecast.backtest(
        _trends(spark, folder), _impact(spark, folder), DAILY_FORECAST)


def warning_count(spark, folder):
    return forecast.warning_count(_prediction(spark, folder))


# The same over issues that reach every level.

def _tiers(spark, folder):
    reviews = derived.event_reviews(spark, folder)
    return reviews, derived.tier_assignments(reviews)


def _impact_tiers(spark, folder):
    return impact.compute_issue_impact(*_tiers(spark, folder), IMPACT)


def impact_tiers(spark, folder):
    """Without the interval: SQL has no t quantile for the few degrees of freedom of `rare`."""
    return _impact_tiers(spark, folder).drop("diff_ci_low", "diff_ci_high")


def rating_risk_tiers(spark, folder):
    series = cut_lineage(trends.build_issue_trends(*_tiers(spark, folder), DAILY))
    return forecast.predict_rating_risk(
        series, cut_lineage(_impact_tiers(spark, folder)), DAILY_FORECAST)


def warnings_of_tiers(spark, folder):
    return forecast.warning_count(rating_risk_tiers(spark, folder))


def filter_of_tiers(spark, folder):
    df = views.risk_level_filter(rating_risk_tiers(spark, folder), ["LOW", "MEDIUM"])
    return df.select("issue_id", "risk_level")


# --- text ----------------------------------------------------------------------------

def _documents(spark, folder):
    return clean.with_clean_text(derived.document_reviews(spark, folder))


def _tokenized(spark, folder):
    words = [*textfeat.stop_words(TEXT), *derived.APP_NAME.lower().split()]
    return textfeat.review_tokens(_documents(spark, folder), words)


def complaint_filter(spark, folder):
    return issues.complaints(_documents(spark, folder), TEXT).select("review_id", "rating")


def app_words(spark, folder):
    return textfeat.app_name_words(derived.document_reviews(spark, folder))


def tokens(spark, folder):
    return _tokenized(spark, folder).select(
        "review_id", F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"))


def ngram_counts(spark, folder):
    return textfeat.term_counts(_tokenized(spark, folder), TEXT).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def vocabulary(spark, folder):
    docs = _tokenized(spark, folder)
    n = docs.select(F.count(F.lit(1))).scalar()
    return rounded(textfeat.vocabulary(textfeat.term_counts(docs, TEXT), n, TEXT))


def tfidf_weights(spark, folder):
    return rounded(textfeat.weigh_terms(_tokenized(spark, folder), TEXT))


def _clusters(spark, folder):
    docs = _tokenized(spark, folder)
    return textfeat.parted_weights(docs, TEXT), derived.language_clusters(docs)


def cluster_keywords(spark, folder):
    top = labels.top_terms(labels.centroids(*_clusters(spark, folder)), TEXT.top_keywords)
    return rounded(top.select("cluster_id", "rank", "term", "mean_weight"))


def readable_labels(spark, folder):
    centres = labels.centroids(*_clusters(spark, folder))
    words = labels.cluster_keywords(centres, TEXT.top_keywords)
    return words.select(
        "cluster_id", F.array_join("keywords", ", ").alias("issue_keywords"),
        labels.readable_label(F.col("keywords")).alias("issue_label"),
        labels.issue_id(F.col("cluster_id")).alias("issue_id"))


def representatives(spark, folder):
    weights, members = _clusters(spark, folder)
    return labels.representatives(
        weights, members, write_table(labels.centroids(weights, members)), TEXT)


def cluster_stats(spark, folder):
    members = derived.language_clusters(derived.document_reviews(spark, folder))
    return rounded(labels.cluster_stats(members))


def extract_issues(spark, folder):
    cleaned = clean.build_cleaned(
        derived.document_reviews(spark, folder).drop("lang"))
    return issues.extract_issues(cleaned, params=TEXT).assignments


def choose_k_embeddings(spark, folder):
    rows = derived.read(spark, folder, "embeddings")
    features = rows.select(
        F.concat(F.lit("vec_"), "vec_id").alias("review_id"),
        array_to_vector("embedding").alias("features"))
    return cluster_vectors(features, rows.count(), None, TEXT).members


# --- views ---------------------------------------------------------------------------

def monthly_rating(spark, folder):
    cleaned = clean.add_features(_documents(spark, folder))
    return rounded(views.monthly_rating(cleaned))


def kpis(spark, folder):
    reviews = derived.event_reviews(spark, folder)
    return views.compute_kpis(reviews, _prediction(spark, folder), _summary(spark, folder))


def ranked(spark, folder):
    df = views.warning_ranked(_prediction(spark, folder))
    return df.select("issue_id", "issue_label", "risk_level", "predicted_rating_impact")


def top_warnings(spark, folder):
    return views.top_warnings(_prediction(spark, folder)).select("issue_id", "risk_level")


def risk_filter(spark, folder):
    df = views.risk_level_filter(_prediction(spark, folder), ["LOW", "MEDIUM"])
    return df.select("issue_id", "risk_level")


def evidence_top(spark, folder):
    reviews, assigned = _inputs(spark, folder)
    return views.evidence_top(assigned, reviews)


def evidence_one(spark, folder):
    reviews, assigned = _inputs(spark, folder)
    return views.representative_reviews(assigned, reviews, "issue_error")


def impact_long(spark, folder):
    return views.impact_long(_impact(spark, folder))


def regression_bars(spark, folder):
    return rounded(views.regression_bars(_impact(spark, folder)))


def impact_display(spark, folder):
    return views.impact_display(_prediction(spark, folder))


def display_table(spark, folder):
    df = views.display_table(_prediction(spark, folder))
    return rounded(add(df, share_text=format_percent("(current_share_pct / 100)"),
                       impact_text=format_stars("historical_impact")))


def issue_gloss(spark, folder):
    _, assigned = _inputs(spark, folder)
    words = assigned.withColumn(
        "issue_keywords", F.concat_ws(", ", F.substring("issue_id", 7, 50), "issue_label"))
    return views.issue_gloss(words, _impact(spark, folder))


def as_of(spark, folder):
    return trends.as_of_date(_trends(spark, folder))


# --- streams -------------------------------------------------------------------------

def _new_store(spark):
    """A store of its own in the shared folder, and a folder for the state of a stream."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return ReviewStore(spark, f"{folder}/store"), f"{folder}/state"


def streamed_reviews(spark, folder):
    """The cleaned table after the reviews have come as a stream."""
    store, state = _new_store(spark)
    reviews = derived.dirty_reviews(spark, folder, derived.stream)
    ingest_stream(reviews, store, "reviews", state).awaitTermination()
    return store.read("cleaned_reviews")


def streamed_trends(spark, folder):
    """The weekly series after the assigned reviews have come as a stream."""
    store, state = _new_store(spark)
    reviews = derived.event_reviews(spark, folder, derived.stream)
    trends_stream(derived.assigned_reviews(reviews), store, "trends", state, WEEKLY).awaitTermination()
    return rounded(store.read("issue_trends"))


QUERIES: dict[str, Query] = {
    "standardize_google_play": google_play,
    "standardize_app_store": app_store,
    "stacked_sources": stacked,
    "validate_flags": flags,
    "validated_reviews": validated,
    "validation_report": report,
    "clean_text": cleaned_text,
    "cleaned_features": cleaned_features,
    "data_quality": quality,
    "period_totals": period_totals,
    "issue_period_agg": period_stats,
    "issue_trends_daily": partial(issue_trends, params=DAILY),
    "issue_trends_weekly": partial(issue_trends, params=WEEKLY),
    "streamed_reviews": streamed_reviews,
    "streamed_issue_trends": streamed_trends,
    "anomalies": anomalies,
    "issue_summary": issue_summary,
    "risk_scores": risk_scores,
    "impact_group_stats": group_stats,
    "impact_welch_parts": welch,
    "impact_mann_whitney_z": mann_whitney,
    "impact_hc3": hc3,
    "impact_table": impact_table,
    "impact_p_values": impact_p_values,
    "share_forecast": share_forecast,
    "penalty_choice": penalty_choice,
    "rating_risk": rating_risk,
    "rating_risk_burden": burden_risk,
    "backtest_windows": backtest_windows,
    "backtest_report": backtest_report,
    "warning_count": warning_count,
    "impact_table_tiers": impact_tiers,
    "rating_risk_tiers": rating_risk_tiers,
    "warning_count_tiers": warnings_of_tiers,
    "risk_level_filter_tiers": filter_of_tiers,
    "complaint_filter": complaint_filter,
    "app_name_words": app_words,
    "tokens": tokens,
    "ngrams": ngram_counts,
    "vocabulary": vocabulary,
    "tfidf_weights": tfidf_weights,
    "cluster_keywords": cluster_keywords,
    "readable_labels": readable_labels,
    "representatives": representatives,
    "cluster_stats": cluster_stats,
    "extract_issues": extract_issues,
    "choose_k_embeddings": choose_k_embeddings,
    "monthly_rating": monthly_rating,
    "kpis": kpis,
    "warning_ranked": ranked,
    "top_warnings": top_warnings,
    "risk_level_filter": risk_filter,
    "evidence_topk": evidence_top,
    "evidence_one_issue": evidence_one,
    "impact_long": impact_long,
    "regression_bars": regression_bars,
    "impact_display": impact_display,
    "display_table": display_table,
    "issue_gloss": issue_gloss,
    "as_of_date": as_of,
}
