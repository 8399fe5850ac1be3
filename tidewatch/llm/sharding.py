"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record belongs to one of `n_slots` virtual slots by the hash of its columns and stays
there for ever. Only the map from slots to shards changes: it is balanced on the bytes of
each slot, and every edit of it is a new version. The map has one row per slot, so its
size depends on the parameter `n_slots` and never on the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import cut_lineage, row_key, shared_folder

N_SLOTS = 4096


def virtual_slot(columns: list[str], n_slots: int = N_SLOTS) -> Column:
    """Slot of a record; nulls are values of their own."""
    parts = [p for c in columns for p in (F.col(c), F.col(c).isNull())]
    return F.pmod(F.xxhash64(*parts), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones too.

    Needs `virtual_slot` and `size`. Sums are taken before the shuffle, so a slot that
    holds a third of all rows is a few rows after it.
    """
    spark = records.sparkSession
    sums = records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return (every.join(sums, "virtual_slot", "left")
            .select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"),
                    F.coalesce("rows", F.lit(0)).alias("rows")))


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: slots from the largest on, each to the lightest shard.

    Ties go to the lower slot and the lower shard. Returns
    (version, virtual_slot, shard, bytes, rows). The fold runs over one array of slots,
    whose length is the parameter.
    """
    placed = (
        loads.groupBy().agg(F.array_sort(F.collect_list(
            F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "rows"))).alias("slots"))
        .select(F.expr(f"""
            aggregate(slots,
              named_struct('load', array_repeat(0L, {n_shards}),
                           'out', CAST(array() AS ARRAY<STRUCT<s: INT, h: INT, b: BIGINT, r: BIGINT>>)),
              (a, x) -> transform(array(CAST(array_position(a.load, array_min(a.load)) AS INT) - 1),
                h -> named_struct(
                  'load', transform(a.load, (v, i) -> IF(i = h, v - x.b, v)),
                  'out', concat(a.out, array(named_struct(
                     's', x.virtual_slot, 'h', h, 'b', -x.b, 'r', x.rows)))))[0]).out
            """).alias("out")))
    return (placed.select(F.explode("out").alias("o"))
            .select(F.lit(1).alias("version"), F.col("o.s").alias("virtual_slot"),
                    F.col("o.h").alias("shard"), F.col("o.b").alias("bytes"),
                    F.col("o.r").alias("rows")))


def rebalance(current: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of a map for new loads or another number of shards.

    A slot stays where it is while its shard, filled from its largest slot on, is below
    the mean load (and still exists); the others move to the lightest shards. Slots are
    moved whole, so no record changes its slot.
    """
    joined = loads.join(current.select("version", "virtual_slot", "shard"), "virtual_slot")
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = joined.agg((F.sum("bytes") / F.lit(n_shards)).alias("mean"),
                      F.max("version").alias("last"))
    marked = (joined.withColumn("filled", F.sum("bytes").over(order))
              .join(F.broadcast(mean), F.lit(True))  # one row
              .withColumn("stays", (F.col("shard") < n_shards) & (F.col("filled") <= F.col("mean"))))
    placed = marked.groupBy("last").agg(
        F.collect_list(F.when(F.col("stays"), F.struct(
            "virtual_slot", "shard", "bytes", "rows"))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct(
            (-F.col("bytes")).alias("b"), "virtual_slot", "rows")))).alias("moved"))
    out = placed.select("last", F.expr(f"""
        aggregate(moved,
          named_struct('load', transform(sequence(0, {n_shards - 1}), i -> aggregate(
                         filter(kept, k -> k.shard = i), 0L, (t, k) -> t + k.bytes)),
                       'out', transform(kept, k -> named_struct(
                         's', k.virtual_slot, 'h', k.shard, 'b', k.bytes, 'r', k.rows))),
          (a, x) -> transform(array(CAST(array_position(a.load, array_min(a.load)) AS INT) - 1),
            h -> named_struct(
              'load', transform(a.load, (v, i) -> IF(i = h, v - x.b, v)),
              'out', concat(a.out, array(named_struct(
                 's', x.virtual_slot, 'h', h, 'b', -x.b, 'r', x.rows)))))[0]).out
        """).alias("out"))
    return (out.select("last", F.explode("out").alias("o"))
            .select((F.col("last") + 1).alias("version"), F.col("o.s").alias("virtual_slot"),
                    F.col("o.h").alias("shard"), F.col("o.b").alias("bytes"),
                    F.col("o.r").alias("rows")))


def save_version(version: DataFrame, path: str) -> None:
    """Append one version of the map to the stored table; older versions stay readable."""
    version.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def load_version(spark, path: str, version: int | None = None) -> DataFrame:
    """The named version of a stored map, the newest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def place(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add `shard` and `position` (gapless from 0 in each shard).

    Needs `virtual_slot`, `order_key` and the columns of `mapping`. Positions are the
    rows of the shard's earlier slots plus the place in the record's own slot; only
    slots are ever sorted, shards never are. The map is broadcast: it has `n_slots` rows.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(
        Window.unboundedPreceding, -1)
    slots = mapping.select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy("order_key")
    return (records.withColumn("inside", F.row_number().over(inside))
            .join(F.broadcast(slots), "virtual_slot")
            .withColumn("position", (F.col("first") + F.col("inside") - 1).cast("long"))
            .drop("first", "inside"))


def spread_repeats(records: DataFrame, n_slots: int) -> DataFrame:
    """Add `part`: 0, or for rows equal in `same` that outgrow a slot one of several parts.

    Equal rows that weigh more than the mean slot are dealt to as many parts as slots they
    fill; they are interchangeable, so it does not matter which of them goes where. There
    are fewer such groups than slots, whatever the number of rows.
    """
    groups = records.groupBy("same").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("rows"))
    mean = F.lit(records.select(F.sum("size")).first()[0] or 0) / n_slots
    heavy = groups.filter((F.col("weight") > mean) & (F.col("rows") > 1)).select(
        "same", F.least(F.ceil(F.col("weight") / mean), F.col("rows")).alias("parts"))
    nth = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
    return records.join(F.broadcast(heavy), "same", "left").withColumn("part", nth).drop("parts")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS,
                    path: str | None = None) -> DataFrame:
    """Shard of every document, with near equal bytes per shard.

    Size is the text's UTF-8 bytes plus 1, a null text counting as empty. The slot comes
    from doc_id and text together, so repeated ids do not pile up in one slot; rows equal in
    both share one until they outgrow it. The map from slots to shards is stored under
    `path` (in the shared folder, if not given) and read back; where a map is stored
    already, its next version is an edit of the newest one for the present loads. Null ids
    and texts are values like any other. Repeated rows are each placed. An empty table
    gives no rows. Other columns are not read.

    Returns doc_id, size, text_crc32 (of a null text: of the empty one), law, shard, slot
    (the position in the shard), grown_shard (null under this law), virtual_slot.
    """
    records = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        row_key("doc_id", "text").alias("same"),
        F.struct("doc_id", F.xxhash64("text")).alias("order_key"))
    records = cut_lineage(spread_repeats(records, n_slots).withColumn(
        "virtual_slot", virtual_slot(["same", "part"], n_slots)))
    spark, loads = docs.sparkSession, slot_loads(records, n_slots)
    if path is not None and stored(spark, path):
        version = rebalance(load_version(spark, path), loads, n_shards)
    else:
        path = path or f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
        version = first_map(loads, n_shards)
    save_version(cut_lineage(version), path)
    mapping = load_version(spark, path)
    return place(records, mapping).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot")
