"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.lineage import ensure_checkpoint_dir, sparing

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "packed", "read", "row_key",
           "shared_folder", "shuffle_parts", "sparing"]

def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, read back.

    Unlike a checkpointed frame, which keeps the estimate of the plan it came from, a table
    has its true size. In iterations the estimates would multiply with every join, until
    planning takes longer than the work, and joins would be planned for the wrong sizes. The
    shuffle files of the job are dropped when the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with sparing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def row_key(*columns: str) -> Column:
    """A 64-bit key of the named columns; nulls and empty texts get different keys."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and `record`, a struct of all columns of docs.

    Helper columns can have any name beside it; `select("record.*")` gives the rows back.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(*needed, every.alias("record"))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def root_buckets(rows: int) -> int:
    """About the square root of a row count: as many buckets as rows in a bucket."""
    return max(1, math.isqrt(max(rows, 0)))
