"""Exact removal of repeated substrings, after blockwise suffix sorting with a difference cover.

Positions of a text whose offset modulo `COVER` is in a difference set are the cover
sample: for two equal strings at any two places, some offset below `COVER` leads to sample
positions in both. So a string of `LENGTH` bytes can only be repeated if a sample window of
LENGTH - COVER + 1 bytes in it is. The work goes down in steps:

1. sample windows are counted; the repeated ones, as a bit table of fixed size, leave the
   candidate suffixes, without a shuffle of texts;
2. long ties: candidate stretches are cut where their content says so, and a stretch that
   occurs again with the next LENGTH - 1 bytes settles all its suffixes at once; its first
   occurrence can be the partner of what is left, the others need not;
3. candidates whose bytes between their outermost cuts are in no other one are dropped, and
   of the first occurrences all whose bytes there are in none that is not settled;
4. the other candidates are sorted by their first LENGTH bytes (as a 64-bit hash), one
   bucket of suffixes in a task, and suffixes with an equal neighbour are repeated.

Texts that have candidates are shuffled once, to be cut at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import textvec
from tidewatch.llm.common import cut_lineage, row_key, shuffle_parts, sparing

LENGTH = 400
# A perfect difference set: every residue modulo 183 but 0 is one difference of two of these.
COVER = 183
DIFFERENCES = (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)
WINDOW = LENGTH - COVER + 1
# Bits of the table of repeated windows; more windows only let more candidates pass.
TABLE_BITS = 27
CUT_MASK, CUT_BYTES = np.uint64(31), 8
CHUNK_BYTES = 1 << 19
GROUP_ROWS = 256


class Bytes:
    """Several texts end to end, with the hash of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.offset = np.arange(len(self.raw)) - self.starts[self.doc]
        self.left = self.sizes[self.doc] - self.offset
        power, self.inverse = textvec.powers(len(self.raw) + 1)
        self.cut = None
        self.sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        value = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        return textvec.mixed(value + np.asarray(length).astype(np.uint64))

    def samples(self) -> np.ndarray:
        blocks = np.maximum(self.sizes - WINDOW, -1) // COVER + 1
        within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = np.repeat(self.starts, blocks) + within * COVER
        at = (first[:, None] + np.array(DIFFERENCES)).ravel()
        return at[at + WINDOW <= np.repeat(self.starts + self.sizes, blocks * len(DIFFERENCES))]

    def candidates(self, table: np.ndarray) -> np.ndarray:
        """Mask of positions with LENGTH bytes and a sample window in the table."""
        at = self.samples()
        at = at[_in_table(table, self.hashes(at, WINDOW))]
        first = np.maximum(at - (COVER - 1), self.starts[self.doc[at]])
        n = len(self.raw)
        change = np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        return (np.cumsum(change)[:n] > 0) & (self.left >= LENGTH)

    def cuts(self) -> np.ndarray:
        if self.cut is None:  # `hashes` at all places, also those at the end of a text
            n = max(0, len(self.raw) - CUT_BYTES + 1)
            value = (self.sums[CUT_BYTES:] - self.sums[:n]) * self.inverse[:n]
            at = np.flatnonzero(textvec.mixed(value + np.uint64(CUT_BYTES)) & CUT_MASK == 0)
            self.cut = at[self.left[at] >= CUT_BYTES]
        return self.cut

    def cores(self, candidate: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, stop, first, last): candidates [start, stop) with the same outermost cuts.

        A repeated string has its cuts at the same places in both copies, so the bytes from
        its first cut to its last one are repeated too. `last` is the end of those bytes;
        candidates without a cut inside have first = last.
        """
        at, cut = np.flatnonzero(candidate), self.cuts()
        lo = np.searchsorted(cut, at, "left")
        hi = np.searchsorted(cut, at + (LENGTH - CUT_BYTES), "right") - 1
        none = hi < lo
        lo, hi = np.where(none, -1, lo), np.where(none, -1, hi)
        new = np.ones(len(at), bool)
        new[1:] = ((at[1:] != at[:-1] + 1) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
                   | (self.doc[at[1:]] != self.doc[at[:-1]]))
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(at))
        start, lo, hi = at[begin], lo[begin], hi[begin]
        if not len(cut):
            return start, start + size, start, start
        has = lo >= 0
        return (start, start + size, np.where(has, cut[lo], start),
                np.where(has, cut[hi] + CUT_BYTES, start))

    def stretches(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, stop) between content-defined cuts, all candidates, LENGTH - 1 bytes after."""
        cut = self.cuts()
        start, stop = cut[:-1], cut[1:]
        total = np.concatenate([[0], np.cumsum(candidate)])
        good = ((self.doc[start] == self.doc[stop]) & (self.left[stop] >= LENGTH - 1)
                & (total[stop] - total[start] == stop - start))
        return start[good], stop[good]


def _in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, hit = np.uint64((1 << TABLE_BITS) - 1), np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _chunks(batches):
    """(batch, first row, Bytes) of a few texts at a time."""
    for batch in batches:
        texts = textvec.as_bytes(batch.column("text"))
        for a, b in textvec.chunks(texts, CHUNK_BYTES):
            yield batch, a, texts[a:b], Bytes(texts[a:b])


def runs(rows: DataFrame, parts: int, keep: str, schema: str) -> DataFrame:
    """Rows of runs of equal `h`, one bucket of hashes sorted in a task.

    `keep`: `second` for one row per run, `all` for every row of a run of several, with
    `copy` telling the first from the rest, `open` for those of them with start >= 0. A run
    may be longer than a batch: only the last row is carried on. `needed` is `all` for the
    runs that have a row with known = 0.
    """
    names = [c for c in rows.columns]

    def scan(batches):
        held, tied, wanted_run = None, False, False
        for batch in (*batches, None):
            if batch is None:
                if held is None:
                    return
                cols, final = [np.array([x]) for x in held], True
            elif not batch.num_rows:
                continue
            else:
                cols, final = [batch.column(c).to_numpy() for c in names], False
                if held is not None:
                    cols = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, cols)]
            h = cols[0]
            same = h[1:] == h[:-1]
            before = np.concatenate([[tied], same])  # equal to the row before
            after = np.append(same, False)
            if keep == "needed":  # rows that are not known come first in a run
                begin = np.maximum.accumulate(np.where(before, 0, np.arange(len(h))))
                good = cols[names.index("known")][begin] == 0
                good[(begin == 0) & tied] = wanted_run
                wanted_run = bool(good[-1])
            if not final:
                held, tied = [c[-1] for c in cols], bool(before[-1])
                cols, before, after = [c[:-1] for c in cols], before[:-1], after[:-1]
                good = good[:-1] if keep == "needed" else None
            out = dict(zip(names, cols))
            if keep == "second":
                # A run's second row: equal to the one before, which began the run.
                mask = before & ~np.concatenate([[seen_twice[0]], before[:-1]]) \
                    if len(before) else before
                if len(before):
                    seen_twice[0] = bool(before[-1])
            else:
                mask = before | after
                out["copy"] = before
                if keep == "needed":
                    mask &= good
            if keep == "open":
                mask = mask & (out["start"] >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c][mask]) for c in wanted], names=wanted)

    wanted = [c.split()[0] for c in schema.split(", ")]
    seen_twice = [False]
    order = [c for c in ("h", "known", "key", "start") if c in names]
    return rows.repartition(parts, "h").sortWithinPartitions(*order).mapInArrow(scan, schema)


def repeated_windows(docs: DataFrame) -> np.ndarray:
    """Bit table of the hashes of sample windows that occur at least twice."""

    def sample(batches):
        for _, _, _, some in _chunks(batches):
            yield pa.RecordBatch.from_pydict(
                {"h": some.hashes(some.samples(), WINDOW).view(np.int64)})

    mask = (1 << TABLE_BITS) - 1
    repeated = runs(docs.select("text").mapInArrow(sample, "h long"),
                    shuffle_parts(docs.sparkSession), "second", "h long")
    with sparing(docs.sparkSession):
        words = (repeated.select(F.explode(F.array(
            F.col("h").bitwiseAND(F.lit(mask)),
            F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow())
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _report(ids, texts: list[bytes], covers: list) -> dict:
    """Result columns for texts with their removed bytes (masks, or None for none)."""
    removed, spans, kept = [], [], []
    for text, cover in zip(texts, covers):
        if cover is None:
            removed.append(0), spans.append(0), kept.append(hashlib.sha256(text).hexdigest())
            continue
        removed.append(int(cover.sum()))
        spans.append(int((cover & ~np.concatenate([[False], cover[:-1]])).sum()))
        kept.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~cover].tobytes()).hexdigest())
    return {"doc_id": ids, "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(kept, pa.string())}


def _place(some: Bytes, keys: np.ndarray, marks: pd.DataFrame, tail: int) -> np.ndarray:
    """Mask of the bytes [start, stop + tail) of each mark in every text that has its key."""
    change = np.zeros(len(some.raw) + 1, np.int64)
    order = np.argsort(keys, kind="stable")
    lo = np.searchsorted(keys[order], marks["key"].to_numpy(), "left")
    hi = np.searchsorted(keys[order], marks["key"].to_numpy(), "right")
    start, stop = marks["start"].to_numpy(np.int64), marks["stop"].to_numpy(np.int64)
    for k in range(int((hi - lo).max(initial=0))):  # over 1 for repeated rows only
        has = lo + k < hi
        base = some.starts[order[(lo + k)[has]]]
        np.add.at(change, base + start[has], 1)
        np.add.at(change, base + stop[has] + tail, -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Removed is each byte of a LENGTH-byte string that also starts elsewhere, in the same or
    another document; strings do not cross documents and are judged on the input. A null
    text counts as empty; texts of fewer bytes keep all. Of repeated rows nothing is kept if
    they are long enough, since each is elsewhere for the other. Other columns are not read.
    Equality is that of 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    parts = shuffle_parts(spark)
    groups = max(1, docs.count() // GROUP_ROWS)
    shared = spark.sparkContext.broadcast(repeated_windows(docs))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Ids travel as text: pandas would turn integers with nulls into floats.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    result = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def ties(batches):
        for batch, a, texts, some in _chunks(batches):
            candidate = some.candidates(shared.value)
            start, stop = some.stretches(candidate)
            keys = batch.column("key").to_numpy()[a:a + len(texts)]
            yield pa.RecordBatch.from_pydict({
                "h": some.hashes(start, stop - start + LENGTH - 1).view(np.int64),
                "key": keys[some.doc[start]], "start": some.offset[start].astype(np.int32),
                "size": (stop - start).astype(np.int32)})

    def split(active):
        """Rows with candidates, or the finished result of those without."""

        def run(batches):
            for batch, a, texts, some in _chunks(batches):
                has = np.zeros(len(texts), bool)
                has[some.doc[some.candidates(shared.value)]] = True
                part = batch.slice(a, len(texts))
                if active:
                    yield part.filter(pa.array(has))
                else:
                    still = part.filter(pa.array(~has))
                    yield pa.RecordBatch.from_pydict(_report(
                        still.column("doc_id"), [t for t, h in zip(texts, has) if not h],
                        [None] * still.num_rows))

        return run

    stretches = rows.select("key", "text").mapInArrow(
        ties, "h long, key long, start int, size int")
    group = F.pmod("key", F.lit(groups)).alias("group")
    settled = cut_lineage(runs(
        stretches, parts, "all", "key long, start int, size int, copy boolean").select(
        group, "key", "start", (F.col("start") + F.col("size")).alias("stop"), "copy"))
    texts = (rows.mapInArrow(split(True), "doc_id string, text string, key long")
             .select("*", group).repartition(parts, "group"))

    def marked(left: pd.DataFrame, right: pd.DataFrame):
        """(Bytes, keys, marks) of a few texts at a time."""
        order = {k: g for k, g in right.groupby("key")} if len(right) else {}
        data = [t.encode("utf-8", "surrogatepass") for t in left["text"]]
        for a, b in textvec.chunks(data, CHUNK_BYTES):
            some, keys = Bytes(data[a:b]), left["key"].to_numpy(np.int64)[a:b]
            found = [order[k] for k in dict.fromkeys(keys.tolist()) if k in order]
            yield some, keys, pd.concat(found) if found else right.iloc[:0]

    def open_pieces(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Runs of candidates with the same core; `known` if a first occurrence settles them.

        Those that only a settled copy covers are left out.
        """
        out = []
        for some, keys, marks in marked(left, right):
            copy = marks["copy"].to_numpy(bool)
            copies = _place(some, keys, marks[copy], 0)
            known = _place(some, keys, marks[~copy], 0)
            candidate = some.candidates(shared.value)
            for state, mask in ((0, candidate & ~known & ~copies), (1, candidate & known)):
                first, end, low, high = some.cores(mask)
                core = textvec.mixed(some.hashes(low, high - low) + np.uint64(1))
                owner, offset = keys[some.doc[first]], some.offset[first]
                # Without a cut there is nothing to compare: such rows go twice, and so stay.
                free = np.flatnonzero(high == low)
                core[free] = textvec.mixed(owner[free].view(np.uint64)
                                           + offset[free].astype(np.uint64))
                open_first = np.full(len(first), state, np.int32)
                out.append(pd.DataFrame({
                    "h": core.view(np.int64), "key": owner, "start": offset.astype(np.int32),
                    "size": (end - first).astype(np.int32), "known": open_first}))
                # A second row, not known: it keeps the run, and the first row keeps its state.
                again = out[-1].iloc[free].copy()
                again["known"], again["size"] = np.int32(0), again["size"] * np.int32(1 - state)
                out.append(again)
        return pd.concat(out) if out else pd.DataFrame(
            {"h": np.empty(0, np.int64), "key": np.empty(0, np.int64),
             "start": np.empty(0, np.int32), "size": np.empty(0, np.int32),
             "known": np.empty(0, np.int32)})

    def open_suffixes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Suffixes of the pieces; those of known ones without a place."""
        out = []
        for some, keys, marks in marked(left, right):
            known = _place(some, keys, marks[marks["known"] == 1], 0)
            at = np.flatnonzero(known | _place(some, keys, marks[marks["known"] == 0], 0))
            out.append(pd.DataFrame({
                "h": some.hashes(at, LENGTH).view(np.int64),
                "key": np.where(known[at], 0, keys[some.doc[at]]),
                "start": np.where(known[at], -1, some.offset[at]).astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame(
            {"h": np.empty(0, np.int64), "key": np.empty(0, np.int64), "start": np.empty(0, np.int32)})

    # All uses of `texts` take the same columns, so they share one shuffle.
    cores = (texts.groupBy("group").cogroup(settled.groupBy("group"))
             .applyInPandas(open_pieces, "h long, key long, start int, size int, known int"))
    pieces = (runs(cores, parts, "needed", "key long, start int, size int, known int")
              .select(group, "key", "start", (F.col("start") + F.col("size")).alias("stop"),
                      "known"))
    suffixes = (texts.groupBy("group")
                .cogroup(pieces.groupBy("group"))
                .applyInPandas(open_suffixes, "h long, key long, start int"))
    repeated = (runs(suffixes, parts, "open", "key long, start int")
                .select(group, "key", "start", (F.col("start") + 1).alias("stop")))
    marks = settled.select("group", "key", "start", "stop").unionByName(repeated)

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        order = {k: g for k, g in right.groupby("key")} if len(right) else {}
        data = [t.encode("utf-8", "surrogatepass") for t in left["text"]]
        for a, b in textvec.chunks(data, CHUNK_BYTES):
            some, keys = Bytes(data[a:b]), left["key"].to_numpy(np.int64)[a:b]
            found = [order[k] for k in dict.fromkeys(keys.tolist()) if k in order]
            cover = _place(some, keys, pd.concat(found) if found else right.iloc[:0], LENGTH - 1)
            covers = np.split(cover, some.starts[1:])
            out.append(pd.DataFrame({k: v if k == "doc_id" else v.to_pylist() for k, v in _report(
                left["doc_id"].iloc[a:b].tolist(), data[a:b], covers).items()}))
        return pd.concat(out) if out else pd.DataFrame(
            columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = (texts.groupBy("group").cogroup(marks.groupBy("group")).applyInPandas(cut, result))
    return (done.unionByName(rows.select("doc_id", "text").mapInArrow(split(False), result))
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


# The definition itself, over all substrings of LENGTH bytes as hexadecimal digits.
REPEATS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS w
  FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
starts AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
marked AS (
  SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 400, true) AS begins
  FROM starts),
runs AS (
  SELECT rid, run, min(i) AS a, max(i) + 400 AS z
  FROM (SELECT rid, i, count(*) FILTER (begins) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked)
  GROUP BY ALL),
before AS (
  SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS free FROM runs),
cut AS (
  SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last,
         string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS kept
  FROM before JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END))
         AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
