"""Reviews that arrive over time: native files to stored raw and cleaned reviews."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.text import has_content, is_blank
from tidewatch.operators.clean import add_features, with_clean_text
from tidewatch.operators.validate import ROW_FLAGS, row_flags
from tidewatch.plans.lineage import write_table
from tidewatch.schemas import REVIEW, SEQ
from tidewatch.sources.native import NATIVE_SCHEMAS, Source, standardizer
from tidewatch.sources.store import ReviewStore

LATENESS = "30 days"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# The records of the state are in files and a cache of bounded size, and not in the heap.
STATE_ON_DISK = {
    STATE_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, unless the session names a provider.

    A stream takes the settings at its start; one with an older checkpoint keeps its provider.
    """
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    chosen = STATE_PROVIDER in {row.key for row in spark.sql("SET").collect()}
    for name, value in STATE_ON_DISK.items() if not chosen else ():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def utc_instant(date: Column) -> Column:
    """A zone-free time as the instant it would be in UTC, in any session's time zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, date))


def stream_native(spark: SparkSession, source: Source, files_per_batch: int | None = None) -> DataFrame:
    """New native files of a source as standard reviews; `ingest_seq` is the file's time."""
    reader = spark.readStream.schema(NATIVE_SCHEMAS[source.platform]).option(
        "multiLine", source.multi_line)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    native = reader.json(source.path).withColumn(
        SEQ, F.unix_micros("_metadata.file_modification_time"))
    return standardizer(source.platform, source.app_id, source.app_name)(native)


def without_redelivery(std: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each record once, however often it is delivered within the lateness.

    Only records that are equal in everything but their place are dropped here, so it does
    not matter which of them stays. The clock is the time of the batch, not the date of the
    review: no record is too late, and only the hashes of recent records are kept.
    """
    columns = [F.col(n) for n in REVIEW.fieldNames()]
    record = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return (std.withColumns({"arrived": F.current_timestamp(), "record": record})
            .withWatermark("arrived", lateness)
            .dropDuplicatesWithinWatermark(["record"])
            .drop("arrived", "record"))


def first_copies(rows: DataFrame) -> DataFrame:
    """The first row of every id by `ingest_seq`, then by content; blank ids are left out."""
    order = Window.partitionBy("review_id").orderBy(SEQ, *REVIEW.fieldNames())
    return (rows.filter(~is_blank(F.col("review_id")))
            .withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy"))


def store_batch(store: ReviewStore, batch: DataFrame, writer: str, number: int) -> None:
    """Add a batch of standard reviews to the raw and the cleaned table, once.

    An id counts by its first copy over all batches, also an invalid one. Cleaned rows are
    written first: they are compared with the raw rows of earlier batches, and a batch that
    failed between the two writes is finished when it is repeated.
    """
    rows = write_table(batch)
    known = store.read("raw_reviews").select("review_id")
    new = first_copies(rows).join(known, "review_id", "left_anti")
    bad = None
    for flag in (row_flags()[n] for n in ROW_FLAGS):
        bad = flag if bad is None else bad | flag
    valid = with_clean_text(new.filter(~bad).select(*REVIEW.fieldNames()))
    store.append("cleaned_reviews", add_features(
        valid.filter(has_content(F.col("cleaned_text")))), (writer, number))
    store.append("raw_reviews", rows, (writer, number))


def ingest_stream(std: DataFrame, store: ReviewStore, writer: str, checkpoint: str,
                  lateness: str = LATENESS, once: bool = True) -> StreamingQuery:
    """Start storing a stream of standard reviews; with `once` it ends when all is read.

    The number of a batch is its write id, so a batch that Spark repeats after a failure
    adds nothing twice.
    """
    def step(batch: DataFrame, number: int) -> None:
        store_batch(store, batch, writer, number)

    stream = (without_redelivery(std, lateness).writeStream.foreachBatch(step)
              .queryName(writer).option("checkpointLocation", checkpoint))
    with state_on_disk(std.sparkSession):
        return (stream.trigger(availableNow=True) if once else stream).start()
