"""Ranked lexical search: best-first over document intervals with range-maximum tables.

Documents are dealt to shards. In a shard every query term has a posting list sorted by
document, and a sparse table over it that names the posting of greatest impact in any
range. The score of every document of an interval is at most the sum over the item's terms
of their greatest impact there. The interval of the greatest bound is split at the document
of its greatest impact, which is scored exactly; its two sides get bounds of their own. The
search of an item ends when no interval can hold a better document than its worst result.

Spark counts terms, deals documents to shards and merges their results; numpy runs within a
shard, which holds about `SHARD_POSTINGS` postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import textvec
from tidewatch.llm.common import cut_lineage, shuffle_parts

TOP = 10
SHARD_POSTINGS = 500_000
SHARD_DOCS = 2000  # smaller shards are not made to have more tasks
# Items are searched in blocks of about so many distinct terms, which bounds what is broadcast.
BLOCK_TERMS = 200_000
BATCH = 128  # intervals split at a time


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, occurrences) of every distinct term, and terms per text."""
    h, doc = textvec.word_hashes(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)])
    counts = np.diff(np.r_[first, len(h)])
    return doc[first], h[first], counts, np.bincount(doc, minlength=len(texts))


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS):
    """Lists of (item number, item_id, term hashes, multiplicities), one list per block.

    The texts of rows with one item_id count as one item; equal rows count once; null texts
    have no terms.
    """
    rows = cut_lineage(items.select("item_id", "text").filter("text IS NOT NULL").distinct())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_terms)))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    for b in range(blocks):
        texts: dict = {}
        for r in numbered.filter(F.col("block") == b).collect():
            texts.setdefault(r.item_id, []).append(r.text.encode("utf-8", "surrogatepass"))
        ids = list(texts)
        doc, h, counts, _ = term_counts([b"\n".join(texts[i]) for i in ids])
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        yield [(k, i, h[a:z], counts[a:z])
               for k, (i, a, z) in enumerate(zip(ids, cuts[:-1], cuts[1:])) if z > a]


def count_documents(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: places in the vocabulary, as packed int32."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        listed = shared.value
        for batch in batches:
            texts = textvec.as_bytes(batch.column(1))
            n, terms, tfs = [], [], []
            for a, z in textvec.chunks(texts):
                h, doc = textvec.word_hashes(texts[a:z])
                n.append(np.bincount(doc, minlength=z - a))
                at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                hit = listed[at] == h
                both, tf = np.unique(doc[hit] * len(listed) + at[hit], return_counts=True)
                cuts = np.searchsorted(both, np.arange(1, z - a) * len(listed))
                terms += [x.tobytes() for x in
                          np.split((both % len(listed)).astype(np.int32), cuts)]
                tfs += [x.tobytes() for x in np.split(tf.astype(np.int32), cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()),
                 pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n long, terms binary, tfs binary")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; every task sends one sum per term."""

    def tally(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            df += np.bincount(np.frombuffer(joined, np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])],
                                         names=["term", "df"])

    sums = (counted.select("terms").mapInArrow(tally, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")).toArrow())
    df = np.zeros(n_terms, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("df").to_numpy()
    return df


class Shard:
    """Posting lists of some documents, in order of doc_id, with sparse tables of maxima."""

    def __init__(self, n, terms: list[bytes], tfs: list[bytes], n_docs: int, length: int):
        big = 75 * int(max(n, default=0)) * n_docs >= 1 << 63
        m = 25 + (75 * np.asarray(n).astype(object if big else np.int64) * n_docs) // length
        per_doc = [len(t) // 4 for t in terms]
        doc = np.repeat(np.arange(len(terms), dtype=np.int32), per_doc)
        term = np.frombuffer(b"".join(terms), np.int32)
        tf = np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m.astype(np.int64)[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact, self.n_docs = doc[order], impact[order], len(terms)
        self.terms, starts = np.unique(term[order], return_index=True)
        self.starts = np.r_[starts, len(term)]
        # best[k][i]: the posting of greatest impact in [i, i + 2**k), the first of equal ones.
        longest = int(np.diff(self.starts).max(initial=1))
        levels = longest.bit_length()
        best = np.zeros((levels, len(term) + 1), np.int32)
        best[0, :-1] = np.arange(len(term))
        for k in range(1, levels):
            half, width = 1 << (k - 1), len(term) + 1 - (1 << k)
            left, right = best[k - 1, :width], best[k - 1, half:half + width]
            best[k, :width] = np.where(self.impact[right] > self.impact[left], right, left)
        self.width, self.best = len(term) + 1, best.ravel()
        self.level = np.zeros(longest + 1, np.int32)
        for k in range(1, levels):
            self.level[1 << k:] = k

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, top: int):
        """(score, place) of the best documents with a score of at least `floor` and above 0."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[there], weights[there][:, None]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # before[t, d]: place of the first posting of term t at document d or later.
        before = np.zeros((len(at), self.n_docs + 1), np.int32)
        for row, t in zip(before, at):
            row[self.doc[self.starts[t]:self.starts[t + 1]] + 1] = 1
        np.cumsum(before, axis=1, out=before)
        before += self.starts[at][:, None].astype(np.int32)

        def bounded(lo, hi):
            """(bound, lo, hi, document of the greatest impact) of intervals."""
            a, z = before[:, lo], before[:, hi]
            length = z - a
            k = self.level[length]
            i = self.best[k * self.width + a]
            j = self.best[k * self.width + z - (1 << k)]
            j = np.where(self.impact[j] > self.impact[i], j, i)
            worth = np.where(length > 0, self.impact[j] * weights, 0)
            widest = j[worth.argmax(axis=0), np.arange(len(lo))]
            return np.stack([worth.sum(axis=0), lo, hi, self.doc[widest]])

        floor = max(floor, 1)
        scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_ = bounded(np.array([0]), np.array([self.n_docs]))
        while True:
            worst = (scores[top - 1], places[top - 1]) if len(scores) >= top else (floor, self.n_docs)
            open_ = open_[:, (open_[0] > worst[0]) | ((open_[0] == worst[0]) & (open_[1] < worst[1]))]
            if not open_.shape[1]:
                return scores, places
            if open_.shape[1] > BATCH:
                order = np.argpartition(-open_[0], BATCH)
                now, open_ = open_[:, order[:BATCH]], open_[:, order[BATCH:]]
            else:
                now, open_ = open_, open_[:, :0]
            _, lo, hi, split = now
            a = before[:, split]
            held = before[:, split + 1] > a
            exact = np.where(held, self.impact[np.minimum(a, len(self.impact) - 1)] * weights, 0)
            scores, places = np.r_[scores, exact.sum(axis=0)], np.r_[places, split]
            order = np.lexsort((places, -scores))[:top]
            order = order[scores[order] >= floor]
            scores, places = scores[order], places[order]
            lo, hi = np.r_[lo, split + 1], np.r_[split, hi]
            some = lo < hi
            if some.any():
                open_ = np.concatenate([open_, bounded(lo[some], hi[some])], axis=1)


def _searcher(shared, top: int):
    """A function that answers every item of the block in one shard of documents."""

    def search(table: pa.Table) -> pa.Table:
        queries, floors, n_docs, length = shared.value
        table = table.sort_by("doc_id")
        shard = Shard(table.column("n").to_numpy(), table.column("terms").to_pylist(),
                      table.column("tfs").to_pylist(), n_docs, length)
        item, score, place = [], [], []
        for k, terms, weights in queries:
            s, p = shard.search(terms, weights, floors.get(k, 0), top)
            item.append(np.full(len(s), k)), score.append(s), place.append(p)
        ids = table.column("doc_id").take(pa.array(np.concatenate([*place, []]).astype(np.int64)))
        return pa.table({"item": pa.array(np.concatenate([*item, []]), pa.int64()), "doc_id": ids,
                         "score": pa.array(np.concatenate([*score, []]), pa.int64())})

    return search


def best_documents(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, block: list, top: int, shard_postings: int) -> DataFrame:
    """item (its number in the block), rank, doc_id, score."""
    context = docs.sparkSession.sparkContext
    vocabulary = np.unique(np.concatenate([h for _, _, h, _ in block]))
    counted = cut_lineage(count_documents(docs, vocabulary).withColumn(
        "row", F.monotonically_increasing_id()))
    n_docs, length, postings = counted.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.length("terms")), F.lit(0))).first()
    df = document_frequencies(counted, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1.0))).astype(np.int64)
    queries = []
    for k, _, h, times in block:
        at = np.searchsorted(vocabulary, h).astype(np.int32)
        queries.append((k, at, weights[at] * times * (df[at] > 0)))
    shards = max(1, -(-postings // (4 * shard_postings)),
                 min(shuffle_parts(docs.sparkSession), n_docs // SHARD_DOCS))
    rows = (counted.filter(F.length("terms") > 0)
            .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
            .select("shard", "doc_id", "n", "terms", "tfs"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def answers(part, floors):
        shared = context.broadcast((queries, floors, n_docs, max(1, length)))
        return part.groupBy("shard").applyInArrow(
            _searcher(shared, top), f"item long, doc_id {kind}, score long")

    # What the first shard finds is a floor for the others.
    first = cut_lineage(answers(rows.filter("shard = 0"), {}))
    floors = dict(best_documents(first, top).filter(F.col("rank") == top)
                  .select("item", "score").collect())
    found = first.union(answers(rows.filter("shard > 0"), floors)) if shards > 1 else first
    return best_documents(found, top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item.

    Whole texts of all documents are counted and searched. Null and empty texts have no
    terms; items without a term that occurs get no rows. Equal scores rank by doc_id, a
    null doc_id last; each of several rows with one doc_id is a document. Rows of one
    item_id are one item, which may be null. Other columns are not read. Empty tables give
    no rows. Terms are told apart by 64-bit hashes within the items' vocabulary.
    """
    spark = docs.sparkSession
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((items, "item_id"), (docs, "doc_id"))]
    out = None
    for block in item_blocks(items, block_terms):
        if not block:
            continue
        names = spark.createDataFrame([(k, i) for k, i, _, _ in block], f"item int, item_id {kinds[0]}")
        part = (search_block(docs, block, top, shard_postings).join(names, "item")
                .select("item_id", "rank", "doc_id", "score"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame(
        [], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
lengths AS (SELECT rid, doc_id, count(*) AS n FROM d GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM lengths),
tf AS (SELECT rid, term, count(*) AS tf FROM d SEMI JOIN i USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole GROUP BY term, n_docs),
scores AS (
  SELECT item_id, rid, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))
           ::BIGINT AS score
  FROM tf JOIN i USING (term) JOIN weights USING (term) JOIN lengths USING (rid), whole
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
       doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
