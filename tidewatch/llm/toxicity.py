"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct words, stems (their first bytes), neighbouring pairs and pairs with
one word between them, hashed to `2**BITS` buckets. Each of `SHARDS` shards of the training rows runs FTRL over
its rows in a fixed order; after every round the shards' states are averaged per bucket
and the next round starts from there. L1 leaves few weights, which are broadcast to score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import textvec
from tidewatch.llm.common import cut_lineage

BITS = 20
# Bound on the labelled rows of a fit; beyond it a sample by hash of doc_id is taken.
MAX_ROWS = 40_000
SHARDS, ROUNDS = 4, 3
PIECE = 1 << 14  # buckets of a shard's state in one row
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
STEM = 6
THRESHOLD = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every feature occurrence."""
    h, doc, stem = textvec.word_hashes(texts, STEM)
    out, docs = [h, stem], [doc, doc]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        pair = h[:-gap] * np.uint64(factor) + h[gap:]
        out.append(textvec.mixed(pair[same]))
        docs.append(doc[gap:][same])
    buckets = (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets, np.concatenate(docs)


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    buckets, docs = features(texts)
    both = np.unique((docs.astype(np.int64) << BITS) | buckets)
    cuts = np.searchsorted(both >> BITS, np.arange(1, len(texts)))
    return np.split(both & ((1 << BITS) - 1), cuts)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0,
                    -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass over the rows, changing z and n in place; the last bucket is the intercept."""
    for x, y in zip(rows, labels):
        x = np.append(x, len(z) - 1)
        w = weights_of(z[x], n[x])
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        root = np.sqrt(n[x] + g * g)
        z[x] += g - (root - np.sqrt(n[x])) / ALPHA * w
        n[x] += g * g


def _shard_pass(start):
    """A function that runs one pass over a shard from a broadcast state (or from nothing)."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        if start.value is not None:
            z[:], n[:] = start.value
        part = part.sort_values(["doc_id", "text"], kind="stable")
        texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in part["text"]]
        x = [f for a, b in textvec.chunks(texts) for f in distinct_features(texts[a:b])]
        order = np.random.default_rng(7).permutation(len(x))
        ftrl_pass([x[i] for i in order], part["toxic"].to_numpy(float)[order], z, n)
        pieces = [(k, z[k:k + PIECE].astype(np.float32).tobytes(),
                   n[k:k + PIECE].astype(np.float32).tobytes()) for k in range(0, len(z), PIECE)]
        return pd.DataFrame(pieces, columns=["at", "z", "n"]).assign(
            shard=part["shard"].iloc[0])

    return learn


def _mean_piece(part: pd.DataFrame) -> pd.DataFrame:
    """Average of the shards' states in one range of buckets."""
    part = part.sort_values("shard")
    mean = {c: np.mean([np.frombuffer(b, np.float32) for b in part[c]], axis=0, dtype=float)
            for c in ("z", "n")}
    return pd.DataFrame([(part["at"].iloc[0], *(mean[c].astype(np.float32).tobytes()
                                               for c in ("z", "n")))], columns=["at", "z", "n"])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows whose crc32(doc_id) mod 4 is not 2.

    A repeated label counts as toxic if any copy is; null labels and ids are left out. Only
    a bounded sample of ids is broadcast.
    """
    rows = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
            .filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2")
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = max_rows / max(1, rows.count())
    part = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(part), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS,
        rounds: int = ROUNDS) -> dict[int, float]:
    """Non-zero weights by bucket, the intercept under 2**BITS; empty without labels."""
    spark = docs.sparkSession
    rows = cut_lineage(training_rows(docs, labels, max_rows).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")))
    state = None
    for _ in range(rounds):
        learn = _shard_pass(spark.sparkContext.broadcast(state))
        pieces = (rows.groupBy("shard").applyInPandas(learn, "at int, z binary, n binary, shard int")
                  .groupBy("at").applyInPandas(_mean_piece, "at int, z binary, n binary")
                  .toArrow().sort_by("at"))  # 2**BITS + 1 pairs of numbers
        if not pieces.num_rows:
            return {}
        state = tuple(np.concatenate([np.frombuffer(b.as_py(), np.float32) for b in pieces[c]])
                      .astype(float) for c in ("z", "n"))
    w = weights_of(*state)
    at = np.flatnonzero(w)
    w = w[at]
    return {int(b): float(v) for b, v in zip(at, w)}


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; nothing is shuffled.

    Null and empty texts have no features and get the intercept's score. A null doc_id
    counts as the empty text in held_out. Without training rows every score is 0.
    Repeated rows get equal scores; other columns are not read.
    """
    at = np.array(sorted(b for b in weights if b < 1 << BITS), np.int64)
    model = docs.sparkSession.sparkContext.broadcast(
        (at, np.array([weights[b] for b in at]), weights.get(1 << BITS, 0.0), bool(weights)))

    def predict(batches):
        at, w, intercept, known = model.value
        table = np.zeros(1 << BITS)
        table[at] = w
        for batch in batches:
            texts = textvec.as_bytes(batch.column("text"))
            total = np.full(len(texts), intercept)
            for a, b in textvec.chunks(texts):
                buckets, docs_ = features(texts[a:b])
                counts = np.flatnonzero(table[buckets])
                both = np.unique((docs_[counts].astype(np.int64) << BITS) | buckets[counts])
                np.add.at(total, a + (both >> BITS), table[both & ((1 << BITS) - 1)])
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) if known else total * 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p),
                 pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    held = F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 4 = 2")
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
