"""Near-duplicate documents by BagMinHash over the multiset of five-word shingles.

Every shingle owns a Poisson process for each dyadic range of its weight, (0, 1], (1, 2],
(2, 4], ...; a point of a range counts for a text if it lies below the shingle's weight
there. Points go to the signature's components at random, and the earliest point of a
component is its value. Two texts agree in a component with the probability of their
weighted Jaccard similarity. Only points up to a time limit are made, which is raised for
the texts that leave a component empty, so the result is that of the endless processes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import textvec
from tidewatch.llm.candidates import bloom, classes, may_contain, open_buckets
from tidewatch.llm.common import cut_lineage, packed

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
CHUNK_BYTES = 1 << 19  # texts whose signatures are made together
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all shingles; a text of fewer words is one shingle of them all."""
    h, doc = textvec.word_hashes(texts)
    sizes = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    value = h[:max(0, len(h) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        value = value * np.uint64(_GOLDEN) + h[k:len(value) + k]
    inside = doc[:len(value)] == doc[WORDS - 1:] if len(value) else np.empty(0, bool)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    few = []
    for d in short:
        x = 0
        for w in h[first[d]:first[d] + sizes[d]].tolist():
            x = (x * _GOLDEN + w + 1) & 0xFFFFFFFFFFFFFFFF
        few.append(x)
    out = np.concatenate([value[inside], np.array(few, np.uint64)])
    return textvec.mixed(out), np.concatenate([doc[:len(value)][inside], short])


def multisets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted."""
    h, doc = shingle_hashes(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(at, append=len(h))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, h, counts = multisets([text.encode("utf-8", "surrogatepass")])
    return h, counts


def sets_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """`shingles` of several texts."""
    doc, h, counts = multisets([t.encode("utf-8", "surrogatepass") for t in texts])
    at = np.searchsorted(doc, np.arange(1, len(texts)))
    return list(zip(np.split(h, at), np.split(counts, at)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int,
               size: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their signatures) of n multisets."""
    total = np.bincount(doc, weight, n)
    present = np.flatnonzero(total)
    signature = np.zeros((n, size), np.uint64)
    limit = np.zeros(n)
    limit[present] = size / total[present] * (np.log(size) + 5)
    todo = np.isin(np.arange(n), present)
    while todo.any():
        own = todo[doc]
        d, e, w = doc[own], h[own], weight[own]
        level, docs, seeds, weights = 0, [], [], []
        levels = []
        while len(d):
            docs.append(d), weights.append(w), levels.append(np.full(len(d), level))
            seeds.append(textvec.mixed(e + np.uint64(level * _GOLDEN & 0xFFFFFFFFFFFFFFFF)))
            more = w > (1 << level)  # the next range begins at 2**level
            d, e, w, level = d[more], e[more], w[more], level + 1
        d, w, seed, lv = (np.concatenate(x) for x in (docs, weights, seeds, levels))
        low = np.where(lv == 0, 0.0, 2.0 ** (lv - 1))
        width = np.where(lv == 0, 1.0, 2.0 ** (lv - 1))
        time, at_doc, at_slot, at_time, at_value = np.zeros(len(d)), [], [], [], []
        while len(d):
            seed = textvec.mixed(seed + np.uint64(_GOLDEN))
            time = time - np.log(_unit(seed)) / width
            alive = time <= limit[d]
            d, w, seed, low, width, time = (x[alive] for x in (d, w, seed, low, width, time))
            place = textvec.mixed(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            value = textvec.mixed(place)
            counts = low + _unit(place) * width < w
            at_doc.append(d[counts]), at_time.append(time[counts]), at_value.append(value[counts])
            at_slot.append(((value[counts] >> np.uint64(32)) * np.uint64(size)
                            >> np.uint64(32)).astype(np.int64))
        where = np.concatenate(at_doc) * size + np.concatenate(at_slot)
        order = np.argsort(-np.concatenate(at_time), kind="stable")
        flat = np.zeros(n * size, np.uint64)
        flat[where[order]] = np.concatenate(at_value)[order]  # the earliest comes last
        filled = np.zeros(n * size, bool)
        filled[where] = True
        whole = filled.reshape(n, size).all(axis=1) & todo
        signature[whole] = flat.reshape(n, size)[whole]
        todo &= ~whole
        limit[todo] *= 2
    return present, signature[present]


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            value = textvec.mixed(value * np.uint64(_GOLDEN) + signature[:, b * rows + r])
        out[:, b] = value
    return out.view(np.int64)


def banded(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, buckets): the band hashes of every (key, text) with words, made once."""

    def make(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            _, first = np.unique(keys, return_index=True)
            part = batch.take(pa.array(np.sort(first)))
            keys, data = part.column("key").to_numpy(), textvec.as_bytes(part.column("text"))
            for a, b in textvec.chunks(data, CHUNK_BYTES):
                present, signature = signatures(*multisets(data[a:b]), b - a, bands * rows)
                bucket = pa.array(band_hashes(signature, bands, rows).ravel())
                ends = pa.array(np.arange(0, len(bucket) + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b][present]), pa.ListArray.from_arrays(ends, bucket)],
                    names=["key", "buckets"])

    return texts.select("key", "text").mapInArrow(make, "key long, buckets array<long>")


def members_of(table: DataFrame, only: np.ndarray) -> DataFrame:
    """(bucket, key) of the banded texts whose bucket may be in the filter."""
    shared = table.sparkSession.sparkContext.broadcast(only)

    def select(batches):
        for batch in batches:
            bucket = batch.column(1).flatten().to_numpy()
            keep = may_contain(shared.value, bucket)
            times = batch.column(1).value_lengths().to_numpy()
            yield pa.RecordBatch.from_pydict({
                "bucket": bucket[keep], "key": np.repeat(batch.column(0).to_numpy(), times)[keep]})

    return table.mapInArrow(select, "bucket long, key long")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys: a filter where the texts lie, then an exact join."""
    shared = texts.sparkSession.sparkContext.broadcast(bloom(wanted, "key"))

    def select(batches):
        for batch in batches:
            keep = may_contain(shared.value, batch.column("key").to_numpy())
            part = batch.filter(pa.array(keep))
            _, first = np.unique(part.column("key").to_numpy(), return_index=True)
            yield part.take(pa.array(np.sort(first)))

    near = texts.select("key", "text").mapInArrow(select, "key long, text string")
    return near.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def keyed(rows: DataFrame) -> DataFrame:
    """Add `key`, a 64-bit name of each text that different texts do not share.

    Texts whose 64-bit hash is equal are told apart by another one; those that differ in it
    are named by that. So texts count as equal by 128 bits.
    """
    other = F.xxhash64(F.lit(7), "text")
    both = rows.withColumns({"key": F.xxhash64("text"), "other": other})
    shared = (both.groupBy("key").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
              .filter("lo <> hi").select("key", F.lit(True).alias("again")))
    shared = cut_lineage(shared)  # one row in about 10^20 / n^2 runs over n texts
    if shared.isEmpty():
        return both.drop("other")
    return (both.join(shared, "key", "left")
            .withColumn("key", F.when(F.col("again"), F.xxhash64(F.lit(11), "other", "key"))
                        .otherwise(F.col("key"))).drop("other", "again"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, root, class_id, class_size of every document.

    Documents are in a class if their texts are equal or linked by pairs whose multisets of
    five-word shingles have a weighted Jaccard similarity of at least the threshold; root, the
    least text hash of the class, is its name, and class_id the least doc_id, which names no
    class where ids are null or repeated. A null text counts as empty, and texts without words
    are in a class with equal texts only. Null ids are never the class_id unless the class has
    no other. Repeated rows are in the same class and count. Other columns are not read.
    """
    texts = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    table = cut_lineage(banded(texts))
    opened = cut_lineage(open_buckets(table.select(F.explode("buckets").alias("bucket"), "key")))
    likely = members_of(table, bloom(opened, "bucket"))
    inside = cut_lineage(likely.join(opened, "bucket", "left_semi").distinct())
    wanted = cut_lineage(inside.select("key").distinct())
    found = classes(inside, cut_lineage(texts_of(texts, wanted)), shingles, threshold,
                    sets_of)
    copies = texts.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = cut_lineage(copies.join(found, F.col("key") == F.col("node"), "left").select(
        "key", F.coalesce("root", "key").alias("root"), "least", "n"))
    whole = cut_lineage(rooted.groupBy("root").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_size")))
    classed = cut_lineage(rooted.join(whole, "root").select(
        "key", "root", "class_id", "class_size"))
    return texts.select("doc_id", "key").join(classed, "key").select(
        "doc_id", "key", "root", "class_id", "class_size")


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the least doc_id, with all its columns.

    Of equal ids that with the least text hash stays, a null id only in a class without
    others. Of rows equal in id and text the first stays, by all columns as JSON, so that
    reruns agree.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    keep = (near_duplicates(docs, threshold).groupBy("root").agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias("id_kept"), F.col("first.key").alias("key_kept")))
    rows = keyed(packed(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    # Ranked within each task before the shuffle: a repeated row is one row after it.
    order = Window.partitionBy("doc_id", "key").orderBy(F.to_json("record"))
    return (rows.select("doc_id", "key", "record")
            .join(keep, F.col("doc_id").eqNullSafe(F.col("id_kept"))
                  & (F.col("key") == F.col("key_kept")), "left_semi")
            .withColumn("nth", F.row_number().over(order)).filter("nth = 1")
            .select("record.*"))
