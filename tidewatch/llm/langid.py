"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text, in windows of `SIZE` bytes; a document's language is
the one of the greatest mean probability over all its bytes. Learning is data-parallel: each
of the training shards runs backpropagation through time over its windows in a Spark task,
the shards' weights are averaged after every round, and the next round starts from there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import bytegru, textvec
from tidewatch.llm.common import cut_lineage

SIZE, HIDDEN = 64, 12
# Bounds on the sample that is learned from: languages, rows of a language, windows of a row.
MAX_LABELS, MAX_ROWS, ROW_WINDOWS = 1000, 1000, 4
SHARD_ROWS, MAX_SHARDS, ROUNDS, STEPS, BATCH, RATE = 500, 8, 8, 40, 64, 0.02
TOGETHER = 2048  # windows labelled at a time
UNKNOWN = "und"


def held_out() -> Column:
    return F.expr("crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 = 0")


def training_windows(docs: DataFrame, max_rows: int = MAX_ROWS,
                     max_labels: int = MAX_LABELS) -> DataFrame:
    """lang, at, n, windows: evenly spaced windows of the sampled rows that may be learned from.

    Of each of the `max_labels` most frequent languages the `max_rows` rows of least hash, or
    all. Null and empty texts and null languages are left out; so is a null doc_id, which
    counts as held out. Texts are cut to windows where they are read; only those move.
    """
    rows = (docs.select("doc_id", "text", "lang").filter(~held_out())
            .filter("lang IS NOT NULL AND length(text) > 0"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels)
    share = F.lit(1.5 * max_rows + 50) / F.col("count")
    part = (rows.withColumn("at", F.xxhash64("doc_id", F.substring("text", 1, 200)))
            .join(F.broadcast(counts), "lang")  # at most max_labels rows
            .filter(F.pmod("at", F.lit(1 << 20)) <= share * (1 << 20))
            .select("lang", "at", "text"))

    def cut(batches):
        for batch in batches:
            out = []
            for text in textvec.as_bytes(batch.column(2)):
                n = -(-len(text) // SIZE)
                some = np.unique(np.linspace(0, n - 1, ROW_WINDOWS).astype(int))
                out.append([text[k * SIZE:(k + 1) * SIZE] for k in some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))],
                names=["lang", "at", "windows"])

    small = part.mapInArrow(cut, "lang string, at long, windows array<binary>")
    order = Window.partitionBy("lang").orderBy("at", F.hash("windows"))
    return small.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_rows)


def _learner(shared, labels: list[str], rate: float, seed: int):
    """A function that learns from each shard in a partition, beginning with the shared weights."""

    def learn(part: pd.DataFrame) -> tuple[int, bytes]:
        p = {k: v.copy() for k, v in shared.value.items()}
        part = part.sort_values(["lang", "at", "n"], kind="stable")
        texts = [bytes(w) for ws in part["windows"] for w in ws]
        known = np.array([labels.index(lang) for lang, ws in zip(part["lang"], part["windows"])
                          for _ in ws])
        data, length, row = bytegru.windows_of(texts, SIZE)
        passes = max(1, -(-STEPS * BATCH // len(data)))
        for k in range(passes):
            bytegru.adam(p, data, length, known[row], BATCH, rate, seed + k)
        packed = np.concatenate([p[k].ravel() for k in bytegru.PARTS]).astype(np.float32)
        return int(part["shard"].iloc[0]), packed.tobytes()

    def learn_all(frames):
        rows = [f for f in frames if len(f)]
        if rows:  # a shard is in one partition; a partition has few shards, mostly one
            done = [learn(part) for _, part in pd.concat(rows).groupby("shard")]
            yield pd.DataFrame(done, columns=["shard", "w"])

    return learn_all


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> tuple[list[str], dict]:
    """The learned languages in order, and the weights; no languages without training rows."""
    context = docs.sparkSession.sparkContext
    rows = cut_lineage(training_windows(docs, max_rows))
    labels = [r.lang for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not labels:
        return [], {}
    shards = min(MAX_SHARDS, max(1, rows.count() // SHARD_ROWS))
    # Every language is dealt over the shards in turn. Shards are placed by range, so that
    # each gets a task: by hash some tasks would get several and some none.
    rows = (cut_lineage(rows.withColumn("shard", (F.col("n") % shards).cast("int")))
            .repartitionByRange(shards, "shard"))
    p = bytegru.initial(HIDDEN, len(labels))
    for r in range(rounds):
        learn = _learner(context.broadcast(p), labels, RATE * (1 - r / rounds), 1000 * r)
        states = sorted(rows.mapInPandas(learn, "shard int, w binary").collect())
        mean = np.mean([np.frombuffer(s.w, np.float32) for s in states], axis=0, dtype=float)
        cuts = np.cumsum([p[k].size for k in bytegru.PARTS])[:-1]
        p = {k: w.reshape(p[k].shape).astype(np.float32)
             for k, w in zip(bytegru.PARTS, np.split(mean, cuts))}
    return labels, p


def document_probabilities(p: dict, texts: list[bytes], labels: int) -> np.ndarray:
    """Mean probability of every label over the bytes of each text; rows of empty texts are 0."""
    total = np.zeros((len(texts), labels))
    data, length, doc = bytegru.windows_of(texts, SIZE)
    for a in range(0, len(data), TOGETHER):
        z = a + TOGETHER
        prob = bytegru.label_positions(p, data[a:z], length[a:z])
        prob *= (np.arange(SIZE)[:, None] < length[a:z])[..., None]
        np.add.at(total, doc[a:z], prob.sum(axis=0, dtype=float))
    return total / np.maximum(1, np.fromiter((len(t) for t in texts), float, len(texts)))[:, None]


def predict(docs: DataFrame, labels: list[str], p: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; nothing is shuffled.

    Null texts, empty ones and those without a letter are `und` with score 0, and so is
    every text when nothing was learned. A null doc_id counts as held out. Texts are read
    whole, whatever their length; repeated rows are each answered; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def label(batches):
        for batch in batches:
            texts = textvec.as_bytes(batch.column("text"))
            readable = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            texts = [t if ok else b"" for t, ok in zip(texts, readable)]
            found = [np.zeros((0, max(1, len(labels))))]
            for a, z in textvec.chunks(texts):
                found.append(document_probabilities(shared.value, texts[a:z], len(labels)))
            prob = np.concatenate(found)
            best = prob.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([labels[k] if ok else UNKNOWN for k, ok in zip(best, readable)], pa.string()),
                 pa.array(np.minimum(1.0, prob[np.arange(len(best)), best]))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(labels))
    rows = docs.select("doc_id", held_out().alias("held_out"), letters.alias("letters"), "text")
    if not labels:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return predict(docs, *fit(docs, max_rows))
