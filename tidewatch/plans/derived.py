"""Review-shaped inputs derived from general event and document tables.

The whole source table is used each time; planted signals move rows between issues and
never drop any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import SEQ, STANDARD

APP_ID = "com.example.app"
STORE_APP_ID = "123456789"
APP_NAME = "Example App"


# A table of less than this per core is read in too few tasks: a row group is one task.
SMALL_PER_CORE = 16 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A source table; one too small for all cores is dealt out by its first column."""
    file = f"{folder}/{table}.parquet"
    rows = spark.read.parquet(file)
    cores = spark.sparkContext.defaultParallelism
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return rows.repartition(cores, rows.columns[0]) if size < cores * SMALL_PER_CORE else rows


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A source table as a stream of its files.

    The path is a pattern, which may name one file; a plain path must be a folder.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


_RATING = "CAST(1 + least(4, floor(value / 25)) AS INT)"


def event_reviews(spark: SparkSession, folder: str, source=read) -> DataFrame:
    """Clean reviews: one per event."""
    return source(spark, folder, "events").selectExpr(
        "concat('ev_', event_id) AS review_id",
        "concat_ws(' ', event_type, props) AS review_text",
        f"{_RATING} AS rating",
        "ts AS review_date",
        "if(event_id % 2 = 0, 'google_play', 'app_store') AS source_platform",
        f"'{APP_ID}' AS app_id", f"'{APP_NAME}' AS app_name",
        "CAST(NULL AS STRING) AS app_version",
        "CASE WHEN event_id % 2 = 0 THEN CAST(user_id % 20 AS INT) END AS helpful_count",
        f"event_id AS {SEQ}",
        "event_id % 100 AS review_length",
        "date_format(ts, 'yyyy-MM') AS review_month",
        "event_id", "event_type")


_ISSUE = """CASE
    WHEN event_type = 'error' AND event_id % 31 >= dayofmonth(review_date) THEN 'other'
    WHEN event_type = 'signup' AND NOT (dayofmonth(review_date) BETWEEN 20 AND 22
         OR event_id % 4 = 0) THEN 'other'
    ELSE event_type END"""


def event_assignments(reviews: DataFrame) -> DataFrame:
    """An issue for every complaint (rating 1 to 3).

    `error` rises day by day and `signup` spikes on three days; the complaints that make
    room for these shapes go to `other`.
    """
    return reviews.selectExpr("review_id", "rating", f"{_ISSUE} AS name").filter(
        "rating <= 3").selectExpr("review_id", "concat('issue_', name) AS issue_id",
                                  "concat(name, ' problem') AS issue_label")


def tier_assignments(reviews: DataFrame) -> DataFrame:
    """Issues of every risk level: by the rating of their complaints and what is missing at the end.

    On the last day the harmful issues are not mentioned, so their forecast lies above it.
    """
    return reviews.selectExpr("review_id", "rating", """CASE
        WHEN event_id BETWEEN 10 AND 13 THEN 'rare'
        WHEN dayofmonth(review_date) = 30 OR rating = 3 THEN 'other'
        WHEN rating = 1 AND event_id % 100 >= 36 THEN 'crash'
        WHEN rating = 1 THEN 'login'
        WHEN event_id % 100 < 85 THEN 'slow' ELSE 'other' END AS name""").filter(
        "rating <= 3").selectExpr("review_id", "concat('issue_', name) AS issue_id",
                                  "concat(name, ' problem') AS issue_label")


def assigned_reviews(reviews: DataFrame) -> DataFrame:
    """All reviews, complaints with their issue: the same issues as `event_assignments`."""
    return reviews.selectExpr(
        "review_date", "rating", f"CASE WHEN rating <= 3 THEN concat('issue_', {_ISSUE}) END AS issue_id")


def dirty_reviews(spark: SparkSession, folder: str, source=read) -> DataFrame:
    """Standard reviews with every kind of defect, then second copies of some rows."""
    broken = event_reviews(spark, folder, source).selectExpr(
        "CASE WHEN event_id % 71 <> 0 THEN review_id END AS review_id",
        "if(event_id % 73 = 0, '   ', review_text) AS review_text",
        "if(event_id % 97 = 0, 9, rating) AS rating",
        "CASE WHEN event_id % 101 <> 0 THEN review_date END AS review_date",
        "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 'web' "
        "ELSE source_platform END AS source_platform",
        "if(event_id % 79 = 0, '', app_id) AS app_id",
        "app_name", "app_version", "helpful_count",
        # 0 for every row and 1 for the second copy of each fiftieth row.
        f"explode(if(event_id % 50 = 0, array(0, 1), array(0))) AS copy", SEQ)
    return broken.withColumn(
        SEQ, F.expr(f"{SEQ} + copy * 1000000000")).select(*STANDARD.fieldNames())


def google_play_native(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the shape of a Google Play export, with malformed values."""
    return read(spark, folder, "events").selectExpr(
        "concat('ev_', event_id) AS reviewId",
        "concat_ws(' ', event_type, props) AS content",
        "CASE WHEN event_id % 40 = 0 THEN '4.5' WHEN event_id % 41 = 0 THEN 'five' "
        f"WHEN event_id % 42 = 0 THEN '4.0' ELSE CAST({_RATING} AS STRING) END AS score",
        "CAST(user_id % 20 AS STRING) AS thumbsUpCount",
        "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '5.4.1' END AS reviewCreatedVersion",
        "'5.0' AS appVersion",
        "CASE WHEN event_id % 43 = 0 THEN 'yesterday' WHEN event_id % 44 = 0 THEN "
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '+02:00' "
        "ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS at",
        f"event_id AS {SEQ}")


def app_store_native(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the shape of an App Store export."""
    return read(spark, folder, "events").selectExpr(
        "CASE WHEN event_id % 17 <> 0 THEN concat('user', user_id) END AS userName",
        "'' AS title", "concat_ws(' ', event_type, props) AS review",
        f"CAST({_RATING} AS STRING) AS rating",
        "CASE event_id % 7 WHEN 1 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') "
        "WHEN 2 THEN date_format(ts, 'MM/dd/yyyy') WHEN 3 THEN date_format(ts, 'MMM d, yyyy') "
        "WHEN 4 THEN date_format(ts, 'yyyyMMdd') WHEN 5 THEN date_format(ts, 'yyyy-13-dd') "
        "ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS date", "'false' AS isEdited",
        f"event_id AS {SEQ}")


def document_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Standard reviews from documents, rated by their labels."""
    labels = read(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return read(spark, folder, "documents").join(labels, "doc_id", "left").selectExpr(
        "concat('doc_', doc_id) AS review_id",
        "text AS review_text",
        "CAST(CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 "
        "WHEN quality = 1 THEN 3 + doc_id % 3 ELSE 1 + doc_id % 5 END AS INT) AS rating",
        "CAST(date_add(DATE '2024-01-01', CAST(doc_id % 84 AS INT)) AS TIMESTAMP_NTZ) "
        "AS review_date",
        "if(doc_id % 2 = 0, 'google_play', 'app_store') AS source_platform",
        f"'{APP_ID}' AS app_id", f"'{APP_NAME}' AS app_name", "source AS app_version",
        "CAST(NULL AS INT) AS helpful_count", f"doc_id AS {SEQ}", "lang")


def language_clusters(reviews: DataFrame) -> DataFrame:
    """A given clustering: one cluster per language."""
    return reviews.selectExpr(
        "review_id", "rating",
        "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 "
        "ELSE 4 END AS cluster_id")
