"""Issue series that follow a stream of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.exprs import sql
from tidewatch.operators.trends import issue_grid, series_metrics
from tidewatch.params import TrendParams
from tidewatch.plans.lineage import write_table
from tidewatch.schemas import TRENDS
from tidewatch.sources.store import ReviewStore
from tidewatch.streaming.ingest import LATENESS, utc_instant

# Width of a period and its offset from the epoch, a Thursday: weeks begin on Monday.
_WINDOWS = {"D": ("1 day", None), "W": ("7 days", "4 days")}


def stream_counts(assigned: DataFrame, freq: str = "W", lateness: str = LATENESS) -> DataFrame:
    """Counts per period and issue of a stream of (review_date, rating, issue_id) rows.

    A review without an issue counts under a null issue. Counts of a period are kept until
    the watermark passes it; later rows of it are dropped.
    """
    if freq not in _WINDOWS:
        raise ValueError(f"streams are counted by {sorted(_WINDOWS)}, not {freq!r}")
    width, offset = _WINDOWS[freq]
    window = F.window("event_time", width, startTime=offset)
    counts = (assigned.filter("review_date IS NOT NULL")
              .withColumn("event_time", utc_instant(F.col("review_date")))
              .withWatermark("event_time", lateness)
              .groupBy(window.alias("period"), "issue_id")
              .agg(F.count(F.lit(1)).alias("mention_count"),
                   F.sum(F.col("rating").cast("bigint")).alias("rating_sum"),
                   F.count("rating").alias("rated_count"),
                   F.count_if(F.col("rating") <= 2).alias("negative_count")))
    days = F.floor(F.unix_seconds("period.start") / 86400).cast("int")
    return counts.select(F.date_add(F.lit("1970-01-01").cast("date"), days).alias("date"),
                         "issue_id", "mention_count", "rating_sum", "rated_count", "negative_count")


def trends_of_counts(counts: DataFrame, params: TrendParams = TrendParams()) -> DataFrame:
    """The series of all issues in all periods of a table of counts."""
    totals = counts.groupBy("date").agg(F.sum("mention_count").alias("total_reviews"))
    stats = counts.filter("issue_id IS NOT NULL").selectExpr(
        "issue_id", "date", "mention_count",
        "rating_sum / CAST(nullif(rated_count, 0) AS DOUBLE) AS average_rating",
        "negative_count / CAST(nullif(mention_count, 0) AS DOUBLE) AS negative_share")
    grid = sql(
        """
        SELECT issue_id, date, coalesce(mention_count, 0) AS mention_count,
               coalesce(mention_count, 0) / total_reviews AS issue_share,
               average_rating, negative_share
        FROM {cells} LEFT JOIN {stats} USING (issue_id, date)""",
        cells=issue_grid(stats, totals), stats=stats)
    return series_metrics(grid, params).select(*TRENDS.fieldNames())


def touched_range(dates: list, changed: list, reach: int):
    """(first date to read, first and last date whose series rows change).

    A period changes its own row and those of the `reach` periods after it, which look back
    on it; these in turn look back on `reach` periods before the first.
    """
    first, last = dates.index(min(changed)), dates.index(max(changed))
    last = min(len(dates) - 1, last + reach)
    return dates[max(0, first - reach)], dates[first], dates[last]


def update_trends(store: ReviewStore, update: DataFrame, params: TrendParams,
                  writer: str, number: int) -> None:
    """Store changed counts and the rows of the series that they change.

    Counts are whole values and not differences, so an update that is repeated changes
    nothing. Whole months are written: the changed months with their other rows. Only
    periods in reach of a change are computed anew; an issue that was never seen before
    changes all periods, as each has a row for it.
    """
    update = write_table(update)
    changed = [r.date for r in update.select("date").distinct().collect()]  # periods of one batch
    if not changed or store.state("issue_trends").has((writer, number)):
        return
    months = sorted({f"{d:%Y-%m}" for d in changed})
    old = store.read("issue_counts", months=months)
    same = old["date"].eqNullSafe(update["date"]) & old["issue_id"].eqNullSafe(update["issue_id"])
    store.replace_months("issue_counts", old.join(update, same, "left_anti").unionByName(update),
                         (writer, number))

    counts = store.read("issue_counts")
    dates = [r.date for r in counts.select("date").distinct().orderBy("date").collect()]
    reach = max(params.rolling_periods, params.growth_lookback)
    known = store.read("issue_trends").select("issue_id").distinct()
    fresh = update.filter("issue_id IS NOT NULL").join(known, "issue_id", "left_anti")
    if fresh.isEmpty():
        read_from, first, last = touched_range(dates, changed, reach)
    else:
        read_from, first, last = dates[0], dates[0], dates[-1]
    # Issues without a mention in the periods read still get their rows.
    issues = counts.filter("issue_id IS NOT NULL").select("issue_id").distinct()
    part = counts.filter(F.col("date").between(read_from, last))
    zero = issues.select(F.lit(read_from).alias("date"), "issue_id", *[
        F.lit(0).cast("bigint").alias(c) for c in ("mention_count", "rating_sum", "rated_count",
                                                   "negative_count")])
    missing = zero.join(part.select("issue_id").distinct(), "issue_id", "left_anti")
    rows = trends_of_counts(part.unionByName(missing), params).filter(
        F.col("date").between(first, last))
    span = sorted({f"{d:%Y-%m}" for d in dates if first <= d <= last})
    rest = store.read("issue_trends", months=span).filter(~F.col("date").between(first, last))
    store.replace_months("issue_trends", rest.unionByName(rows), (writer, number))


def trends_stream(assigned: DataFrame, store: ReviewStore, writer: str, checkpoint: str,
                  params: TrendParams = TrendParams(), lateness: str = LATENESS,
                  once: bool = True) -> StreamingQuery:
    """Start keeping `issue_trends` up to date with a stream of assigned reviews."""
    def step(batch: DataFrame, number: int) -> None:
        update_trends(store, batch, params, writer, number)

    stream = (stream_counts(assigned, params.freq, lateness).writeStream.outputMode("update")
              .foreachBatch(step).queryName(writer).option("checkpointLocation", checkpoint))
    return (stream.trigger(availableNow=True) if once else stream).start()
