"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is a run of `window` consecutive words of a benchmark item (all words of a
shorter item). Its words are ordered by rarity over all documents; since a contained
window needs every one of its words, the necessary prefix is its rarest word. Documents
are probed by their words: a hit on a prefix word names the offsets at which a window can
lie, the window must fit into the document there (length and positional bound), and the
words in between are compared exactly.

Windows go to the tasks in blocks of at most about `block_windows`, so what is broadcast
is bounded by a parameter however large the benchmark is; every block sees all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import cut_lineage, packed

WINDOW = 10
BLOCK_WINDOWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words as bytes of UTF-8, after ASCII lower-casing.
WORD_BYTES = rb"[0-9a-z\x80-\xff]+"

N_WORDS, N_HIT, ITEMS = "n_words__", "n_hit__", "items__"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id string, words): a null id is the empty string, a null text has none."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                     words.alias("w"))
        .filter("size(w) > 0")
        .select("item_id", F.explode(F.expr(
            f"transform(sequence(0, greatest(size(w) - {window}, 0)), "
            f"i -> slice(w, i + 1, {window}))")).alias("words"))
        .distinct())


def _words(text) -> list[bytes]:
    return re.findall(WORD_BYTES, text.encode("utf-8", "surrogatepass").lower()) if text else []


def word_frequencies(docs: DataFrame, vocabulary) -> dict[bytes, int]:
    """Occurrences of the listed words in all documents.

    `vocabulary` is the broadcast word set of one block; the result has its size.
    """

    def count(batches):
        listed = vocabulary.value
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update([w for w in _words(text) if w in listed])
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(found), pa.binary()),
                 "n": pa.array(list(found.values()), pa.int64())})

    counts = docs.select("text").mapInArrow(count, "word binary, n long")
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def prefix_index(rows, frequency: dict[bytes, int]) -> dict:
    """rarest word -> offset of it in the window -> window -> item ids."""
    index: dict = {}
    for item, words in rows:
        window = tuple(w.encode("utf-8") for w in words)
        offset = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i]))
        by_window = index.setdefault(window[offset], {}).setdefault((offset, len(window)), {})
        by_window.setdefault(window, []).append(item)
    return index


def _probe(words: list[bytes], index: dict) -> tuple[set[int], set[str]]:
    hit, items = set(), set()
    n = len(words)
    for i, word in enumerate(words):
        if word in index:
            for (offset, length), windows in index[word].items():
                start = i - offset
                if start >= 0 and start + length <= n:
                    found = windows.get(tuple(words[start:start + length]))
                    if found:
                        hit.update(range(start, start + length))
                        items.update(found)
    return hit, items


def matches(docs: DataFrame, items: DataFrame, carry: list[str], window: int = WINDOW,
            block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The `carry` columns of every document with n_words__, hits__ and items__.

    hits__ are the places of hit words, items__ the ids of items with an occurring window,
    sorted as strings. Rows stay where they are: there is no shuffle of documents. Null
    and empty texts have no words; repeated rows are each answered; with no items nothing
    is hit; other columns pass through untouched.
    """
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(items, window))
    blocks = max(1, -(-2 * windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    out = docs.select("text", *[c for c in carry if c != "text"])
    columns = out.columns
    schema = T.StructType([*out.schema.fields, T.StructField(N_WORDS, T.LongType()),
                           T.StructField("hits__", T.ArrayType(T.IntegerType())),
                           T.StructField(ITEMS, T.ArrayType(T.StringType()))])
    for b in range(blocks):
        rows = [(r.item_id, r.words) for r in numbered.filter(F.col("block") == b).collect()]
        vocabulary = spark.sparkContext.broadcast(
            {w.encode("utf-8") for _, words in rows for w in words})
        index = spark.sparkContext.broadcast(
            prefix_index(rows, word_frequencies(docs, vocabulary)))
        later = b > 0

        def probe(batches, index=index, later=later):
            table = index.value
            for batch in batches:
                n_words, hits, ids = [], [], []
                old = zip(batch.column("hits__").to_pylist(), batch.column(ITEMS).to_pylist()) \
                    if later else ((None, None),) * batch.num_rows
                for text, (h, found) in zip(batch.column("text").to_pylist(), old):
                    words = _words(text)
                    hit, names = _probe(words, table) if words else ((), ())
                    n_words.append(len(words))
                    hits.append(sorted({*hit, *(h or ())}))
                    ids.append(sorted({*names, *(found or ())}))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(n_words, pa.int64()),
                     pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))],
                    names=[*columns, N_WORDS, "hits__", ITEMS])

        out = out.mapInArrow(probe, schema)
        if b + 1 < blocks:
            out = cut_lineage(out)  # each block's worker ends before the next begins
    return out.select(*carry, N_WORDS, "hits__", ITEMS)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    return matches(docs, items, ["doc_id"], window).select(
        "doc_id", F.col(N_WORDS).alias("n_words"),
        F.size("hits__").cast("long").alias("n_hit"),
        F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ","), 256).alias("items_sha256"),
        (F.size("hits__") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    return (matches(packed(docs, "text"), items, ["record"], window)
            .filter(F.size("hits__") == 0).select("record.*"))


CONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
starts AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw, lengths WHERE len(w) >= m)),
found AS (SELECT DISTINCT rid, starts.m, i, item_id FROM starts JOIN windows USING (m, s)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit
         FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found) GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""
