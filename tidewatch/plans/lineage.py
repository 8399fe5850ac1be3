"""Cutting lineage so that lost executors do not replay whole pipelines."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


SPARING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """For jobs inside: shuffle files go when their job ends, Python gets texts 4 MB at a time.

    Otherwise the files of all steps stay until the driver happens to collect its garbage, and
    10,000 texts of any length are in a batch, in the executor and in each of its workers. What
    is returned must not be a lazy frame that reads shuffles of the jobs inside.
    """
    before = {name: spark.conf.get(name, None) for name in SPARING}
    for name, value in SPARING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to reliable storage and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back.

    A table has its true size, where a checkpoint keeps the estimate of its plan. A schema
    may name other types of the same stored form, such as vectors for their structs. The shuffle
    files of the job are dropped when the table is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with sparing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
