"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters from the three before them. Its n-gram counts are tables
keyed by (model, n-gram); a model is a language, or `*` for all trusted text, which serves
languages with little or none. Every distinct n-gram of the corpus is joined with the counts to
get its log probability; these scores are cut into shards of a bounded number of rows,
each shard is joined with all documents where they lie, and the sums per document give
the perplexity. A document is rejected if its perplexity exceeds a high quantile of that
of the trusted, held-out documents of its language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.candidates import bloom, may_contain
from tidewatch.llm.common import cut_lineage, packed, row_key

ORDER = 4
SHARD_ROWS = 1_000_000
# Quantile of held-out trusted perplexity up to which documents stay.
QUANTILE = 0.99
CHUNK_CHARS = 1 << 18
# Rows of n-gram counts that a task holds before it adds them up; if half are left it sends them on.
HELD_ROWS = 1 << 18
POOLED = "*"


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text number) for every character: ORDER characters of 16 bits in an int64.

    Digits are one character, characters beyond the basic plane share 256 codes, and line
    ends stand before the text.
    """
    pad = "\n" * (ORDER - 1)
    joined = "".join([pad + t for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points > 0xFFFF, 0xE000 + (points & 0xFF), points)
    points = np.where((points >= 48) & (points <= 57), 48, points).astype(np.uint64)
    code = np.zeros(len(points), np.uint64)
    for k in range(ORDER):
        code[k:] |= points[:len(points) - k] << np.uint64(16 * k)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(doc)) + (doc + 1) * (ORDER - 1)
    return code[at].view(np.int64), doc


def _by_model(batch):
    """(model, texts, places) for each model in a batch, in chunks; empty texts left out."""
    texts = batch.column("text").to_pylist()
    groups: dict = {}
    for i, (model, text) in enumerate(zip(batch.column("model").to_pylist(), texts)):
        if text:
            groups.setdefault(model, []).append(i)
    for model, places in groups.items():
        part, size = [], 0
        for i in places:
            part.append(i)
            size += len(texts[i])
            if size >= CHUNK_CHARS:
                yield model, [texts[k] for k in part], np.array(part)
                part, size = [], 0
        if part:
            yield model, [texts[k] for k in part], np.array(part)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(model, gram, c) over all texts of (model, text), summed in each task first."""

    def added(parts):
        places, grams = pd.factorize(np.concatenate([g for g, _ in parts]))
        return grams, np.bincount(places, np.concatenate([c for _, c in parts])).astype(np.int64)

    def batch_of(model, grams, counts):
        return pa.RecordBatch.from_pydict({
            "model": pa.repeat(pa.scalar(model, pa.string()), len(grams)),
            "gram": pa.array(grams), "c": pa.array(counts)})

    def count(batches):
        held, n = {}, 0
        for batch in batches:
            for model, texts, _ in _by_model(batch):
                places, grams = pd.factorize(gram_codes(texts)[0])
                held.setdefault(model, []).append((grams, np.bincount(places)))
                n += len(grams)
                if n > HELD_ROWS:
                    held = {model: [added(parts)] for model, parts in held.items()}
                    n = sum(len(parts[0][0]) for parts in held.values())
                    if n > HELD_ROWS // 2:
                        for model, parts in held.items():
                            yield batch_of(model, *parts[0])
                        held, n = {}, 0
        for model, parts in held.items():
            yield batch_of(model, *added(parts))

    return (rows.select("model", "text").mapInArrow(count, "model string, gram long, c long")
            .groupBy("model", "gram").agg(F.sum("c").alias("c")))


def _mask(order: int) -> int:
    return (1 << 16 * order) - 1 if order < 4 else -1


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order 1..ORDER the seen n-grams' discounted shares and the contexts' weights.

    Order k counts are occurrences at the top and numbers of different left neighbours
    below it. Discounts for counts 1, 2 and 3 or more come from the counts of counts of
    the model and order.
    """
    tables = []
    for order in range(ORDER, 0, -1):
        context = F.expr(f"shiftrightunsigned(gram, 16) & {_mask(order - 1)}L") if order > 1 \
            else F.lit(0).cast("long")
        rows = counts.withColumn("context", context)
        number = lambda k: F.count(F.when(F.col("c") == k, 1)).cast("double")
        y = "n1 / greatest(n1 + 2 * n2, 1)"
        discounts = (counts.groupBy("model").agg(*[number(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
                     .select("model", *[F.expr(
                         f"greatest(0.1D, least({k} - 0.05D, {k} - {k + 1} * ({y}) * n{k + 1} "
                         f"/ greatest(n{k}, 1)))").alias(f"d{k}") for k in (1, 2, 3)]))
        per_context = (rows.groupBy("model", "context").agg(
            F.sum("c").alias("total"), number(1).alias("m1"), number(2).alias("m2"),
            F.count(F.when(F.col("c") > 2, 1)).alias("m3"))
            .join(discounts, "model")
            .select("model", "context", "total",
                    F.expr("(d1 * m1 + d2 * m2 + d3 * m3) / total").alias("gamma")))
        seen = (rows.join(per_context.select("model", "context", "total"), ["model", "context"])
                .join(discounts, "model")
                .select("model", "gram", F.expr(
                    "(c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total").alias("share")))
        tables.append((cut_lineage(seen), cut_lineage(per_context.drop("total"))))
        if order > 1:
            counts = cut_lineage(
                counts.select("model", F.expr(f"gram & {_mask(order - 1)}L").alias("gram"))
                .groupBy("model", "gram").agg(F.count(F.lit(1)).alias("c")))
    return tables[::-1]


def log_probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]],
                      alphabet: int = 1 << 16) -> DataFrame:
    """(model, gram, logp) of the given n-grams, seen or not; the base is uniform."""
    out = grams.withColumn("p", F.lit(1.0 / alphabet))
    for order, (seen, contexts) in enumerate(tables, 1):
        context = f"shiftrightunsigned(gram, 16) & {_mask(order - 1)}L" if order > 1 else "0L"
        out = (out.withColumn("g_", F.expr(f"gram & {_mask(order)}L"))
               .withColumn("x_", F.expr(context))
               .join(seen.select("model", F.col("gram").alias("g_"), "share"), ["model", "g_"], "left")
               .join(contexts.select("model", F.col("context").alias("x_"), "gamma"),
                     ["model", "x_"], "left")
               .select("model", "gram", F.expr("coalesce(share, 0D) + coalesce(gamma, 1D) * p")
                       .alias("p")))
    return out.select("model", "gram", F.log("p").alias("logp"))


def held_out(column: str = "doc_id") -> Column:
    return F.expr(f"crc32(CAST(CAST({column} AS STRING) AS BINARY)) % 4 = 2")


def perplexities(rows: DataFrame, scores: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, perplexity) of rows (key, model, text); null for texts without characters.

    One pass per shard of the scores; only one shard of at most about `shard_rows` is
    broadcast to a pass. Rows with equal keys are equal and get one result.
    """
    spark = rows.sparkSession
    shards = max(1, -(-scores.count() // shard_rows))
    numbered = scores.withColumn("shard", F.pmod(F.xxhash64("model", "gram"), F.lit(shards)))
    # One name per language.
    models = [r.model for r in scores.select("model").distinct().orderBy("model").collect()]
    number = F.array_position(F.array(*map(F.lit, models or [""])), F.col("model")).cast("int") - 1
    parts = []
    for k in range(shards):
        table = numbered.filter(F.col("shard") == k).select(
            number.alias("model"), "gram", F.col("logp").cast("float")).toArrow()
        owner, gram, logp = (table.column(c).to_numpy() for c in ("model", "gram", "logp"))
        del table
        order = np.lexsort((gram, owner))
        cuts = np.searchsorted(owner[order], np.arange(1, len(models)))
        by_model = dict(zip(models, zip(np.split(gram[order], cuts), np.split(logp[order], cuts))))
        shared = spark.sparkContext.broadcast(by_model)

        def look_up(batches, shared=shared):
            for batch in batches:
                total, found = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for model, texts, places in _by_model(batch):
                    grams, logp = shared.value.get(model, (np.empty(0, np.int64), None))
                    if not len(grams):
                        continue
                    codes, doc = gram_codes(texts)
                    index, distinct = pd.factorize(codes)
                    at = np.minimum(np.searchsorted(grams, distinct), len(grams) - 1)
                    known = grams[at] == distinct
                    value = np.where(known, logp[at], 0.0)
                    total[places] += np.bincount(doc, value[index], len(texts))
                    found[places] += np.bincount(doc, known[index], len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(total), pa.array(found)],
                    names=["key", "total", "chars"])

        parts.append(rows.mapInArrow(look_up, "key long, total double, chars long")
                     .withColumn("shard", F.lit(k)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.groupBy("key", "shard").agg(F.max("total").alias("total"), F.max("chars").alias("chars"))
    return once.groupBy("key").agg(
        F.when(F.sum("chars") > 0, F.exp(-F.sum("total") / F.sum("chars"))).alias("perplexity"))


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in a table of distinct ids, however many there are.

    A bit table drops most other rows where they lie, so that only texts of these ids, and
    the few others it lets pass, are shuffled to the exact join.
    """
    hashed = F.xxhash64(F.col("doc_id").cast("string")).alias("hash")
    shared = rows.sparkSession.sparkContext.broadcast(bloom(ids.select(hashed), "hash"))

    def likely(batches):
        for batch in batches:
            hit = may_contain(shared.value, batch.column("hash").to_numpy())
            yield batch.filter(pa.array(hit))

    named = rows.filter("doc_id IS NOT NULL").select("*", hashed)
    return named.mapInArrow(likely, named.schema).drop("hash").join(ids, "doc_id")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """key, doc_id, lang, perplexity, ceiling, accepted for every distinct row.

    Trusted text is that of all rows labelled quality 1. Rows with crc32(doc_id) mod 4 = 2 are
    held out of the fit and set the ceilings. Texts without characters have no perplexity
    and are rejected. A language has a model and a ceiling of its own if at least
    1 / (1 - quantile) trusted rows are in its fit and as many held out; all others and a
    null language use the pooled model. Its ceiling is the greater of the quantiles, by that
    same model, of all held-out rows and of those of the languages that use it. With
    none at all every text with characters is accepted. Repeated rows count once here. Other
    columns are not read.
    """
    trusted = cut_lineage(
        labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    rows = docs.select("doc_id", "lang", "text")
    usable = rows.filter("text <> ''")
    least = int(np.ceil(1 / (1 - quantile) - 1e-9))
    number = lambda which: F.count_distinct(F.when(which, F.col("doc_id")))
    languages = [r.lang for r in usable.filter("lang IS NOT NULL").select("doc_id", "lang")
                 .join(trusted, "doc_id").groupBy("lang").agg(
                     number(held_out()).alias("dev"), number(~held_out()).alias("fit"))
                 .filter(f"least(dev, fit) >= {least}").select("lang").collect()]
    # The fitted texts are read once and the held-out ones, a quarter, three times.
    fit = cut_lineage(gram_counts(rows_of(
        usable.filter(~held_out()).filter("lang IS NOT NULL"), trusted.filter(~held_out()))
        .select(F.col("lang").alias("model"), "text")))
    pooled = fit.groupBy(F.lit(POOLED).alias("model"), "gram").agg(F.sum("c").alias("c"))
    own = fit.filter(F.col("model").isin(languages))
    tables = kneser_ney(cut_lineage(own.unionByName(pooled)))
    key = row_key("doc_id", "lang", "text").alias("key")
    named = rows.select(
        key, "doc_id", "lang", "text",
        F.when(F.col("lang").isin(languages), F.col("lang")).otherwise(POOLED).alias("model"))
    every = cut_lineage(rows_of(usable.filter(held_out()), trusted.filter(held_out()))
                        .select(key, F.lit(POOLED).alias("model"), "text"))
    wanted = gram_counts(named.select("model", "text").unionByName(every.select("model", "text")))
    scores = cut_lineage(log_probabilities(wanted.select("model", "gram"), tables))
    found = perplexities(named.select("key", "model", "text"), scores)
    ids = named.select("key", "doc_id", "lang", "model").dropDuplicates(["key"])
    scored = cut_lineage(ids.join(found, "key"))
    dev = scored.filter(held_out()).join(trusted, "doc_id").filter("perplexity IS NOT NULL")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    # One row per language with a model of its own, and one for all.
    bounds = F.broadcast(dev.groupBy("model").agg(limit.alias("own")))
    overall = F.broadcast(cut_lineage(
        perplexities(every, scores.filter(F.col("model") == POOLED)).agg(limit.alias("pooled"))))
    ceiling = (F.when(F.col("model") == POOLED, F.greatest("own", "pooled"))
               .otherwise(F.coalesce("own", "pooled")))
    return (scored.join(bounds, "model", "left").join(overall, F.lit(True), "left")
            .select("key", "doc_id", "lang", "perplexity", ceiling.alias("ceiling"))
            .withColumn("accepted", F.col("perplexity").isNotNull() & F.coalesce(
                F.col("perplexity") <= F.col("ceiling"), F.lit(True))))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows of documents with all their columns; copies stay copies."""
    rejected = quality(docs, labels).filter("NOT accepted").select(F.col("key").alias("key__"))
    return (packed(docs, row_key("doc_id", "lang", "text").alias("key_"))
            .join(rejected, F.col("key_") == F.col("key__"), "left_anti").select("record.*"))
