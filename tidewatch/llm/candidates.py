"""From banded signatures to classes of similar texts, without pairs of whole buckets.

A text is named by a 64-bit hash (`key`), a band of its signature by another (`bucket`).
In a bucket that holds texts of different classes every text is compared with two leaders.
Verified pairs are joined to classes; then buckets that still hold several classes get
other leaders, as long as leaders find many links. The buckets that are open then are
finished exactly: of one with few texts all pairs of different classes are compared, and of
larger ones those that share one of their rarest shingles, as similar texts must. Pairs meet
as bit tables of their shingles first; texts travel only for those that may be similar.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import textvec
from tidewatch.llm.common import cut_lineage, shuffle_parts, sparing
from tidewatch.llm.components import connected_components

# Size of the filter that is broadcast, whatever the number of keys. More keys make it let
# more rows pass, which costs time only: what passes is joined exactly afterwards.
BLOOM_BITS = 25
# Another round of leaders is worth it if this share of the last round's pairs was linked.
WORTH = 0.25
# Slots of the table by which shingles are ordered from rare to common, whatever their number.
SLOT_BITS = 20
# Outsiders of a shingle's most common class that are compared in one group of the join.
BLOCK = 256
PREFIX_ROWS = 1 << 18
# Texts of a bucket whose pairs are compared by their bit tables alone, in one task, and rows
# of whole buckets that are compared together.
FEW, FEW_ROWS = 512, 1 << 14
PAIR_BYTES = 1 << 18
# A list of keys of so many pairs is broadcast.
FEW_PAIRS = 10_000
# Bits of a text in which it is compared before its shingles are, and the longs they fill.
SKETCH_BITS = 10
WORDS = [f"w{k}" for k in range(1 << (SKETCH_BITS - 6))]
SKETCH_SCHEMA = ", ".join(f"{c} long" for c in ("key", "size", *WORDS))
# Codes of sizes that a member may carry.
CODES = 1 << 16
_GOLDEN = 0x9E3779B97F4A7C15


def bloom(rows: DataFrame, column: str) -> np.ndarray:
    """Bit table of the column's values, which must be uniform 64-bit hashes: 4 MB."""
    mask = (1 << BLOOM_BITS) - 1
    bits = rows.select(F.explode(F.array(
        F.col(column).bitwiseAND(F.lit(mask)),
        F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(mask)))).alias("p"))
    with sparing(rows.sparkSession):
        words = bits.groupBy(F.shiftright("p", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def may_contain(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mask of the int64 values that may be in the filter; every value in it is."""
    v, mask = values.view(np.uint64), np.uint64((1 << BLOOM_BITS) - 1)
    hit = np.ones(len(v), bool)
    for p in (v & mask, (v >> np.uint64(32)) & mask):
        hit &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def open_buckets(rows: DataFrame) -> DataFrame:
    """(bucket) of those with different keys; aggregated before the shuffle."""
    return (rows.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
            .filter("lo <> hi").select("bucket"))


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of two multisets as (sorted distinct hashes, counts)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    size = a[1].sum() + b[1].sum()
    if not len(a[0]):
        return 0.0 if size else 1.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return common / (size - common)


def sketches(sets: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bit tables) of multisets; a bit tells if an odd number of elements falls on it.

    Tables of two multisets differ in no more bits than the multisets in elements.
    """
    h, counts = (np.concatenate(x) for x in zip(*sets))
    lengths = np.fromiter((len(x) for x, _ in sets), np.int64, len(sets))
    who = np.repeat(np.arange(len(sets)), lengths)
    if (counts > 1).any():
        h, who = elements(h, counts), np.repeat(who, counts)
    at = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    odd = np.bincount((who << SKETCH_BITS) + at, minlength=len(sets) << SKETCH_BITS) & 1
    bits = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return np.bincount(who, minlength=len(sets)), bits.reshape(len(sets), -1)


def alike(i: np.ndarray, j: np.ndarray, size: np.ndarray, bits: np.ndarray,
          threshold: float) -> np.ndarray:
    """Mask of the pairs whose bit tables differ in no more bits than elements may."""
    apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
    return apart <= (1 - threshold) / (1 + threshold) * (size[i] + size[j]) + 1e-6


def sketch_rows(keys, sets: list[tuple]) -> pa.RecordBatch:
    """(key, size, w0, w1, …): sizes and bit tables of some sets."""
    size, bits = sketches(sets)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(size), *map(pa.array, bits.view(np.int64).T.copy())],
        names=["key", "size", *WORDS])


def sketch_table(texts: DataFrame, many: Callable) -> DataFrame:
    """Sizes and bit tables of (key, text), each text read once."""

    def make(batches):
        for batch in batches:
            keys, data = batch.column("key"), batch.column("text").to_pylist()
            for a, b in textvec.chunks(data, PAIR_BYTES):
                yield sketch_rows(keys[a:b], many(data[a:b]))

    return texts.select("key", "text").mapInArrow(make, SKETCH_SCHEMA)


def sides(rows: DataFrame, pairs: DataFrame, n_pairs: int) -> list[DataFrame]:
    """Of (key, …) the rows that the pairs can meet as a, and as b.

    Few pairs are looked up where the rows lie, so that the rest is not shuffled.
    """
    if n_pairs > FEW_PAIRS:
        return [rows, rows]
    return [rows.join(F.broadcast(pairs.select(F.col(k).alias("key")).distinct()), "key", "left_semi")
            for k in ("a", "b")]


def likely(pairs: DataFrame, table: DataFrame, threshold: float, n_pairs: int) -> DataFrame:
    """The pairs (a, b) that the bit tables of `sketch_table` leave open."""
    left, right = (side.select(F.col("key").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in table.columns[1:]])
                   for k, side in zip("ab", sides(table, pairs, n_pairs)))
    apart = " + ".join(f"bit_count(a_{w} ^ b_{w})" for w in WORDS)
    near = F.expr(f"{apart} <= {(1 - threshold) / (1 + threshold)!r}D * (a_size + b_size) + 1e-6D")
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b")


def similar(i: np.ndarray, j: np.ndarray, sets: list[tuple], threshold: float) -> np.ndarray:
    """Mask of the pairs (sets[i], sets[j]) that reach the similarity.

    Those whose bit tables differ in more bits than elements may are left out before.
    """
    keep = alike(i, j, *sketches(sets), threshold)
    for k in np.flatnonzero(keep):
        keep[k] = weighted_jaccard(sets[i[k]], sets[j[k]]) >= threshold
    return keep


def verified(pairs: DataFrame, texts: Callable, many: Callable, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the exact similarity.

    `texts` gives (key, text) of a table of keys, `many` the multisets of a list of texts.
    """

    def test(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in textvec.chunks([u + v for u, v in zip(x, y)], 2 * PAIR_BYTES):
                both = x[lo:hi] + y[lo:hi]
                _, first, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]),
                                         return_index=True, return_inverse=True)
                sets = many([both[k] for k in first])
                keep[lo:hi] = similar(at[:hi - lo], at[hi - lo:], sets, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    keys = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    found = cut_lineage(texts(keys))
    left = found.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = found.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        test, "a long, b long")


def elements(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set of hashes, in which the copies of a shingle are elements of their own."""
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return textvec.mixed(np.repeat(h, counts) + copy.astype(np.uint64) * np.uint64(_GOLDEN))


def slot_counts(texts: DataFrame, shingles: Callable) -> np.ndarray:
    """How many elements of the texts fall in each slot: 8 MB."""

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, elements(*shingles(text)) >> np.uint64(64 - SLOT_BITS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": at, "n": total[at]})

    with sparing(texts.sparkSession):
        found = (texts.select("text").mapInArrow(count, "slot long, n long")
                 .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros(1 << SLOT_BITS, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def prefixes(texts: DataFrame, shingles: Callable, threshold: float) -> DataFrame:
    """(key, label, token, place, size): the rarest elements of every (key, label, text).

    All texts order their elements alike, and two that reach the threshold share one of the
    first `size - threshold * size + 1`.
    """
    shared = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, shingles))
    names = ["key", "label", "token", "place", "size"]

    def make(batches):
        for batch in batches:
            keys, labels = (batch.column(c).to_numpy() for c in ("key", "label"))
            parts, at, rows = [], [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                e = elements(*shingles(text))
                take = len(e) - int(np.ceil(threshold * len(e) - 1e-9)) + 1
                order = np.lexsort((e, shared.value[e >> np.uint64(64 - SLOT_BITS)]))[:take]
                parts.append((e[order].view(np.int64), np.arange(len(order)),
                              np.full(len(order), len(e))))
                at.append(np.full(len(order), i))
                rows += len(order)
                if rows >= PREFIX_ROWS or i == batch.num_rows - 1:
                    who = np.concatenate(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (keys[who], labels[who],
                                               *map(np.concatenate, zip(*parts)))], names=names)
                    parts, at, rows = [], [], 0

    return texts.select("key", "label", "text").mapInArrow(
        make, "key long, label long, token long, place long, size long")


def prefix_pairs(texts: DataFrame, shingles: Callable, threshold: float) -> DataFrame:
    """(a, b): all pairs of different classes of (key, label, text) that may reach the threshold.

    Of the texts with a token only those outside its most common class are joined with all,
    in blocks, so pairs within a large class are never made and no token's group is in one
    task. Sizes and places leave out pairs whose overlap cannot suffice.
    """
    rows = cut_lineage(prefixes(texts, shingles, threshold))
    groups = (rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"),
                                    F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
              .filter("labels > 1")
              .select("token", F.col("most.label").alias("main"),
                      F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("blocks")))
    grouped = cut_lineage(rows.join(groups, "token"))
    left = grouped.filter("label <> main").select(
        "token", F.pmod(F.xxhash64("key"), "blocks").alias("block"), F.col("key").alias("x"),
        F.col("label").alias("label_x"), F.col("place").alias("i"), F.col("size").alias("n"))
    right = grouped.select(
        "token", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
        F.col("key").alias("y"), F.col("label").alias("label_y"), F.col("place").alias("j"),
        F.col("size").alias("m"))
    near = (F.col("label_x") != F.col("label_y")) & F.expr(
        f"least(n, m) >= {threshold}D * greatest(n, m) - 1e-6D AND least(n - i, m - j) "
        f">= {threshold / (1 + threshold)!r}D * (n + m) - 1e-6D")
    return (left.join(right, ["token", "block"]).filter(near)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def near_pairs(rows: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different labels in a bucket of (bucket, key, label) that may be similar.

    The rows of a bucket meet as bit tables in one task, so buckets should have few rows; only
    pairs that the tables leave open are made.
    """

    def compare(held):
        bucket, key, label, size = (np.concatenate([b.column(c).to_numpy() for b in held])
                                    for c in ("bucket", "key", "label", "size"))
        bits = np.column_stack([np.concatenate([b.column(c).to_numpy() for b in held])
                                for c in WORDS]).view(np.uint64)
        i, step, found = np.arange(len(key)), 0, []
        while True:  # the rows of a bucket are neighbours: all pairs with so many rows between
            step += 1
            i = i[i + step < len(key)]
            i = i[bucket[i] == bucket[i + step]]
            if not len(i):
                break
            own = i[label[i] != label[i + step]]
            own = own[alike(own, own + step, size, bits, threshold)]
            found.append(np.column_stack([key[own], key[own + step]]))
        pairs = np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                          names=["a", "b"])

    def gather(batches):
        held, n = [], 0
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            held.append(batch)
            n += len(bucket)
            # All but the last bucket, which may go on, are whole.
            open_rows = len(bucket) - np.searchsorted(bucket, bucket[-1]) if len(bucket) else 0
            if n >= FEW_ROWS and 0 < open_rows < len(bucket):
                cut = len(bucket) - open_rows
                held[-1] = batch.slice(0, cut)
                yield compare(held)
                held, n = [batch.slice(cut)], open_rows
        if held:
            yield compare(held)

    parts = shuffle_parts(rows.sparkSession)
    return (rows.join(table, "key").repartition(parts, "bucket").sortWithinPartitions("bucket")
            .select("bucket", "key", "label", "size", *WORDS)
            .mapInArrow(gather, "a long, b long").distinct())


def classes(members: DataFrame, texts: DataFrame | Callable, shingles: Callable, threshold: float,
            many: Callable | None = None, table: DataFrame | None = None, gap: int = CODES) -> DataFrame:
    """(node, root) of all texts with a verified link.

    `members` is (bucket, key) of the open buckets and `texts` (key, text) of their keys, or
    what gives it for some of the keys. Members may have a `code` below CODES; then only those
    with codes no more than `gap` apart are similar. `table` is the `sketch_table` of all keys, if
    it is made. All are read in every round, so they should be written tables. A bucket costs as
    many comparisons as twice its texts in a round of leaders, and at the end FEW / 2 times its
    texts if it has no more than FEW, most of them of bit tables only. Rounds only save work: at
    the end every pair of a bucket is in one class, compared, or too far apart by its bit tables
    or prefixes.
    """
    spark = members.sparkSession
    many = many or (lambda some: [shingles(text) for text in some])
    if isinstance(texts, DataFrame):
        all_texts = texts
        texts = lambda keys: all_texts.join(keys, "key", "left_semi")
        table = cut_lineage(sketch_table(all_texts, many))
    if "code" not in members.columns:
        members = members.select("bucket", "key", F.lit(0).alias("code"))
    tested = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, root long")
    turn, leading = 0, True
    while True:
        labelled = members.join(labels, members["key"] == labels["node"], "left").select(
            "bucket", "key", F.coalesce("root", "key").alias("label"), "code")
        # Each bucket draws its own leaders, so a text meets different ones in every band.
        order = F.xxhash64("key", "bucket", F.lit(turn)).bitwiseAND(-CODES).bitwiseOR(F.col("code"))
        entry = F.struct(order.alias("order"), "key", "label")
        # A round of leaders has compared all pairs of three texts.
        opened = cut_lineage(
            labelled.groupBy("bucket").agg(
                F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"),
                *([F.array(F.min(entry), F.max(entry)).alias("leaders")] if leading else []))
            .filter("lo <> hi").filter(f"n > {3 if turn else 0}").drop("lo", "hi"))
        if opened.isEmpty():
            return labels
        if leading:
            leaders = opened.select("bucket", F.explode("leaders").alias("leader"))
            apart = F.abs(F.col("code") - F.col("leader.order").bitwiseAND(CODES - 1))
            pairs = (labelled.join(leaders, "bucket")
                     .filter("label <> leader.label").filter(apart <= gap)
                     .select(F.least("key", "leader.key").alias("a"),
                             F.greatest("key", "leader.key").alias("b")).distinct())
        else:
            rest = labelled.join(opened, "bucket")
            pairs = near_pairs(rest.filter(f"n <= {FEW}"), table, threshold)
            large = opened.filter(f"n > {FEW}")
            if not large.isEmpty():
                named = cut_lineage(rest.filter(f"n > {FEW}").select("key", "label").distinct())
                some = cut_lineage(texts(named.select("key").distinct()).join(named, "key"))
                found = cut_lineage(prefix_pairs(some, shingles, threshold))
                pairs = pairs.unionByName(likely(
                    found, cut_lineage(sketch_table(some, many)), threshold, found.count())).distinct()
        pairs = cut_lineage(pairs.join(tested, ["a", "b"], "left_anti"))
        n_pairs = pairs.count()
        # Those of the last round have met by their bit tables.
        maybe = cut_lineage(likely(pairs, table, threshold, n_pairs)) if leading else pairs
        links = cut_lineage(verified(maybe, texts, many, threshold))
        n_links = links.count()
        if n_links:
            labels = merged(labels, links)
        if not leading:
            return labels
        leading = n_links > WORTH * n_pairs
        tested = tested.unionByName(pairs)
        turn += 1


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after new links: only the roots that the links join are connected anew."""
    root = lambda side: (links.join(labels, links[side] == labels["node"], "left")
                         .select("a", "b", F.coalesce("root", side).alias(f"root_{side}")))
    between = root("a").join(root("b"), ["a", "b"]).select(
        F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    found = connected_components(between).select(
        F.col("node").alias("old"), F.col("root").alias("new"))
    moved = labels.join(found, labels["root"] == found["old"], "left").select(
        "node", F.coalesce("new", "root").alias("root"))
    known = labels.select(F.col("node").alias("old"))
    fresh = found.join(known, "old", "left_anti").select(
        F.col("old").alias("node"), F.col("new").alias("root"))
    return cut_lineage(moved.unionByName(fresh))
