"""JSON arrays of objects, read by many tasks.

Spark's text reader cuts files by byte ranges at a separator; with `}` as separator a piece
ends where an object may end. Whether it does depends on what stands before: strings and
nested objects. So the pieces of every block are summed up first, as what they do to a state
of (inside a string, depth), once for either state of the string. Running over the blocks of
a file, one row each, gives the state in which every block begins. Then blocks cut out their
objects independently; only the parts of an object that lies across blocks move.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidewatch.plans.lineage import write_table
from tidewatch.schemas import SEQ

_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)
_BETWEEN = " \t\r\n,[]"


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): the text up to each closing brace, in the order of the file."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def effect(piece: str) -> tuple[bool, int, int]:
    """(string flips, depth change from outside a string, from inside) of a piece and its brace.

    No escape crosses the border of a piece: an escaped brace is not JSON.
    """
    inside, change = False, [0, 0]
    for mark in _MARKS.findall(piece):
        if mark == '"':
            inside = not inside
        elif mark in "{}":
            change[inside] += 1 if mark == "{" else -1
    change[inside] -= 1
    return inside, change[0], change[1]


def _block_effects(batches):
    """(file, block, flips, outside, inside) of the pieces of each block in a task."""
    found: dict = {}
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
            flips, outside, within = effect(piece)
            old = found.get((file, block), (False, 0, 0))
            if old[0]:  # a string that began before turns the two states around
                outside, within = within, outside
            found[file, block] = (old[0] ^ flips, old[1] + outside, old[2] + within)
    keys = list(found)
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([k[0] for k in keys], pa.string()),
        "block": pa.array([k[1] for k in keys], pa.int64()),
        "flips": pa.array([found[k][0] for k in keys], pa.bool_()),
        "outside": pa.array([found[k][1] for k in keys], pa.int64()),
        "inside": pa.array([found[k][2] for k in keys], pa.int64())})


def _run_over_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one file begins."""
    blocks = blocks.sort_values("block")
    string, depth, states = False, 0, []
    for flips, outside, inside in zip(blocks["flips"], blocks["outside"], blocks["inside"]):
        states.append((string, depth))
        depth += inside if string else outside
        string ^= flips
    return pd.DataFrame({"file": blocks["file"], "block": blocks["block"],
                         "string": [s for s, _ in states], "depth": [d for _, d in states]})


def _cut(batches):
    """(file, block, place, open, text): whole objects of a block, and parts of others.

    `open` tells what is missing: `start` of a part that ends an object or lies inside one,
    `end` of a part that begins one.
    """
    at, string, depth, held, place, started = None, False, 0, [], 0, False
    rows: list = []

    def close():
        if at is not None and (held or not started):
            # Unfinished at the end of the block; without a brace it is what follows the array.
            text = "".join(p + "}" for p in held)
            if text.strip(_BETWEEN + "}") or not started:
                rows.append((*at, place, "end" if started else "start", text))

    for batch in batches:
        for file, block, piece, s, d in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                close()
                at, string, depth, held, place = (file, block), s, d, [], 0
                started = not s and d <= 0  # else the block begins inside an object
            flips, outside, inside = effect(piece)
            held.append(piece)
            depth += inside if string else outside
            string ^= flips
            if not string and depth <= 0:
                text = "".join(p + "}" for p in held)
                if started:
                    rows.append((*at, place, "", text.lstrip(_BETWEEN)))
                    place += 1
                else:
                    rows.append((*at, -1, "start", text))
                held, depth, started = [], 0, True
        yield _table(rows)
        rows.clear()
    close()
    yield _table(rows)


def _table(rows: list) -> pa.RecordBatch:
    names = ["file", "block", "place", "open", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _joined(parts: DataFrame) -> DataFrame:
    """Whole objects from the parts in several blocks of a file.

    A part without its start belongs to the nearest part before that has one.
    """
    order = Window.partitionBy("file").orderBy("block", F.when(F.col("open") == "start", 0).otherwise(1))
    begun = F.last(F.when(F.col("open") == "end", F.col("block")), ignorenulls=True).over(order)
    part = F.struct("block", F.when(F.col("open") == "start", 1).otherwise(0).alias("later"), "text")
    return (parts.withColumn("begun", begun).filter("begun IS NOT NULL")
            .groupBy("file", F.col("begun").alias("block"))
            .agg(F.max(F.when(F.col("open") == "end", F.col("place"))).alias("place"),
                 F.array_sort(F.collect_list(part)).alias("parts"))
            .select("file", "block", "place", F.array_join("parts.text", "").alias("text")))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(ingest_seq, text) of the objects of JSON arrays, numbered by file and place.

    A file is read by as many tasks as it has blocks. Objects may be nested and hold braces,
    quotes and escapes in strings, and be longer than a block. Files of objects without an
    array, one after another, are read alike.
    """
    pieces = pieces_of(spark, path)
    states = write_table(
        pieces.mapInArrow(_block_effects, "file string, block long, flips boolean, outside long, inside long")
        .groupBy("file").applyInPandas(_run_over_blocks, "file string, block long, string boolean, depth long"))
    cut = write_table(
        pieces.join(F.broadcast(states), ["file", "block"])  # one row per block of the input
        .select("file", "block", "piece", "string", "depth")
        .mapInArrow(_cut, "file string, block long, place long, open string, text string"))
    across = _joined(cut.filter("open <> ''")).withColumn("text", F.ltrim(F.col("text"), F.lit(_BETWEEN)))
    objects = (cut.filter("open = ''").select("file", "block", "place", "text").unionByName(across)
               .filter("text LIKE '{%'"))
    by = ["file", "block"]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = objects.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return objects.join(starts, by).select((F.col("first") + F.col("place")).alias(SEQ), "text")


def read_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of JSON arrays as rows of the schema with `ingest_seq`."""
    return read_objects(spark, path).select(
        F.from_json("text", schema).alias("o"), SEQ).select("o.*", SEQ)
