"""The whole analysis: standard reviews in, seven stored tables out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.clean import build_cleaned, cleaning_report
from tidewatch.operators.forecast import backtest, predict_rating_risk, warning_count
from tidewatch.operators.impact import compute_issue_impact
from tidewatch.operators.issues import extract_issues
from tidewatch.operators.risk import score_issues
from tidewatch.operators.trends import build_issue_trends
from tidewatch.params import Params
from tidewatch.plans.lineage import write_table
from tidewatch.schemas import SEQ, TABLES
from tidewatch.sources.native import Source, read_numbered, stack_sources
from tidewatch.sources.store import ReviewStore


@dataclass
class RunSummary:
    row_counts: dict[str, int]
    report: DataFrame
    backtest: DataFrame
    n_warnings: int
    k: int
    method: str


def ingest(spark: SparkSession, sources: Iterable[Source],
           store: ReviewStore | None = None) -> DataFrame:
    """Standard reviews of all sources; with a store the native records are kept too.

    What is kept is also what is standardized: a source is not read again after its records,
    with their numbers, are in the store.
    """
    sources = list(sources)
    if store is not None:
        loaded = []
        for s in sources:
            native = s.native
            if native is None:
                native = read_numbered(spark, s.path, s.platform, s.multi_line)
            elif SEQ not in native.columns:
                native = native.withColumn(SEQ, F.monotonically_increasing_id())
            kept = store.save_raw(s, native)
            loaded.append(replace(s, native=spark.read.schema(native.schema).json(kept)))
        sources = loaded
    return stack_sources(spark, sources)


def run(std: DataFrame, store: ReviewStore, params: Params = Params()) -> RunSummary:
    """Run every stage and replace every table.

    The input is evaluated once, into a table of its rows with their numbers. Each table is
    written once and the next stages read it back from the store, so a lost executor never
    replays an earlier stage and nothing is kept in memory between stages.
    """
    std = write_table(std)
    store.replace("raw_reviews", std)
    store.replace("cleaned_reviews", build_cleaned(std))
    cleaned = store.read("cleaned_reviews")

    issues = extract_issues(cleaned, params=params.text)
    store.replace("review_issues", issues.assignments)
    assignments = store.read("review_issues")

    store.replace("issue_trends", build_issue_trends(cleaned, assignments, params.trend))
    trends = store.read("issue_trends")
    store.replace("issue_summary", score_issues(trends, assignments, params.trend))

    store.replace("issue_impact", compute_issue_impact(cleaned, assignments, params.impact))
    impact = store.read("issue_impact")
    forecast = replace(params.forecast, freq=params.trend.freq)
    store.replace("issue_prediction", predict_rating_risk(trends, impact, forecast))

    return RunSummary(
        row_counts={t: store.row_count(t) for t in TABLES},
        report=cleaning_report(std),
        backtest=backtest(trends, impact, forecast),
        n_warnings=warning_count(store.read("issue_prediction")).first()[0],
        k=issues.k,
        method=issues.method,
    )
