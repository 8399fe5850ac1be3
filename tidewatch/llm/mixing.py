"""Mixing sources to target weights by blocks of a fixed number of words.

The words of a source's documents form one stream that is cut into blocks of equal
length. Every output shard draws how many blocks it takes from each source, a source's
draws are numbered through all shards, and the j-th draw takes the block at the j-th place
of a pseudorandom permutation of the source's blocks (again from the start after each
whole pass). Draws and blocks meet in an equi-join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import cut_lineage, packed, root_buckets, shuffle_parts

BLOCK_WORDS = 32
SHARD_BLOCKS = 1024
MAX_PASSES = 3
ROUNDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size).

    Weights 1, 2, 3 repeat over the sources in code point order, null last. A target is
    min(max_passes x size, level x weight), where the level makes all targets add up to
    all sizes; that is where repeated resharing of the excess ends. One row per source.
    """
    ranked = (sizes
              .withColumn("weight", ((F.row_number().over(
                  Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
              .withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    whole = Window.partitionBy(F.lit(0))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    filled = ranked.withColumn("level", level)
    # The first source that the level leaves below its cap sets the level of all after it.
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    return filled.select(
        "source", "weight", "source_size",
        F.coalesce(F.least("cap", final["level"] * F.col("weight")), "cap").alias("target"))


def stream_offsets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Add `start`: words of the same source before this document, its size and target.

    A source may hold a third of all documents, so its stream is ordered by a hash bucket
    and then inside the bucket. Buckets and rows in a bucket both grow with the square
    root of the table.
    """
    buckets = root_buckets(docs.count())
    placed = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = Window.partitionBy("source")
    earlier = F.sum("bucket_size").over(per_source.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1))
    firsts = (sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                          F.coalesce(earlier, F.lit(0)).alias("first"))
              .join(targets.select(F.col("source").alias("t"), "source_size", "target"),
                    F.col("s").eqNullSafe(F.col("t"))).drop("t"))
    inside = (Window.partitionBy("source", "bucket").orderBy("doc_id", "mark")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(firsts, F.col("source").eqNullSafe(F.col("s"))
                  & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("first") + F.col("inside"))
            .drop("s", "b", "bucket", "first", "inside"))


def draws(targets: DataFrame, seed: int, block: int = BLOCK_WORDS,
          shard_blocks: int = SHARD_BLOCKS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(shard, source, n_blocks, taken, first): blocks each output shard takes of a source.

    A shard's slots go to the sources as whole expected numbers first; the slots that
    remain are drawn from the multinomial distribution of the remainders, so the counts
    have the target as mean and vary little. `first` numbers a source's draws over the
    shards; draws beyond `max_passes` passes over the source stay empty.
    """
    # A source's last block is shorter, so a block is its words by its blocks on average.
    want = F.when(F.col("source_size") > 0, F.col("target") * F.ceil(
        F.col("source_size") / block) / F.col("source_size")).otherwise(0.0)
    one = (targets.groupBy().agg(
        F.sum(want).alias("total"),
        F.array_sort(F.collect_list(F.struct(
            F.col("source").isNull().alias("last"), "source",
            F.ceil(F.col("source_size") / block).alias("n_blocks"),
            want.alias("want"))))
        .alias("sources"))
        .withColumn("blocks", F.round("total").cast("long")))
    # The last shard is as short as the rest of the mix.
    per_shard = (
        one.filter("blocks > 0")
        .select("*", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {shard_blocks})"))
                .alias("shard"))
        .withColumn("slots", F.least(F.lit(shard_blocks), F.col("blocks")
                                     - F.col("shard") * shard_blocks))
        .withColumn("means", F.expr("transform(sources, s -> s.want / total * slots)"))
        .withColumn("left", F.expr(
            "slots - aggregate(means, 0L, (t, m) -> t + CAST(floor(m) AS BIGINT))"))
        .withColumn("bounds", F.expr(
            "aggregate(means, CAST(array() AS ARRAY<DOUBLE>), (a, m) -> "
            "array_append(a, coalesce(try_element_at(a, -1), 0D) + m - floor(m)))"))
        .withColumn("picked", F.expr(f"""
            transform(filter(sequence(0L, greatest(left, 1L) - 1), i -> i < left), i ->
              least(size(sources) - 1, size(filter(bounds, b -> b <=
                (xxhash64({seed}L, shard, i) & 9007199254740991L) / 9007199254740992D
                * element_at(bounds, -1)))))"""))
        .select("shard", "picked", "means", F.posexplode("sources").alias("i", "s"))
        .select("shard", F.col("s.source").alias("source"), F.col("s.n_blocks").alias("n_blocks"),
                F.expr("CAST(floor(means[i]) AS BIGINT) + size(filter(picked, k -> k = i))")
                .alias("drawn")))
    # Two steps, since a source has as many rows here as there are output shards.
    group = F.floor(F.sqrt("shard")).cast("long")
    grouped = per_shard.withColumn("group", group)
    sums = grouped.groupBy("source", "group").agg(F.sum("drawn").alias("group_drawn"))
    past = lambda column, order: F.coalesce(F.sum(column).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.select(F.col("source").alias("s"), F.col("group").alias("g"), past(
        "group_drawn", Window.partitionBy("source").orderBy("group")).alias("group_first"))
    inside = Window.partitionBy("source", "group").orderBy("shard")
    limit = F.col("n_blocks") * max_passes
    return (grouped.withColumn("inside", past("drawn", inside))
            .join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
            .withColumn("first", F.col("group_first") + F.col("inside"))
            .withColumn("taken", F.greatest(F.lit(0), F.least("drawn", limit - F.col("first"))))
            .filter("taken > 0").select("shard", "source", "n_blocks", "first", "taken"))


def permuted(index: str, n: str, source: str, seed: int, rounds: int = ROUNDS) -> Column:
    """Pseudorandom permutation of 0..n-1 by swap-or-not rounds, for any n.

    A round pairs x with k - x mod n and swaps the two if a hash bit of the pair is set.
    """
    return F.expr(f"""
        aggregate(sequence(1, {rounds}), {index}, (x, r) -> transform(
          array(pmod(pmod(xxhash64({seed}L, r, {source}), {n}) - x, {n})), y ->
          IF((xxhash64({seed}L, -r, {source}, greatest(x, y)) & 1L) = 1L, y, x))[0])""")


def drawn_blocks(drawn: DataFrame, seed: int) -> DataFrame:
    """(shard, place, source, block) of every output slot, unrolled shard by shard."""
    parts = shuffle_parts(drawn.sparkSession)
    return (
        drawn.repartition(parts, "shard", "source")
        .withColumn("j", F.explode(F.expr("sequence(first, first + taken - 1)")))
        .withColumn("place", F.col("j") - F.col("first"))
        .withColumn("block", permuted("pmod(j, n_blocks)", "n_blocks", "source", seed))
        .select("shard", "place", "source", "block"))


def document_blocks(streams: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Each document's pieces: (…, block, words) where `words` of it lie in the block."""
    return (
        streams.filter("size > 0")
        .withColumn("block", F.explode(F.expr(
            f"sequence(start div {block}, (start + size - 1) div {block})")))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
                    - F.greatest(F.col("start"), F.col("block") * block)))


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Words that the mix takes of every document.

    Returns doc_id, mark (hash of the text), source, size, source_size, target, taken. A null
    text has size 0 and is never taken; a null source is a source of its own and the last.
    Repeated rows are separate documents. Equal ids or sizes are ordered by the text's hash.
    With no words at all every target is 0; an empty table gives no rows. A document is taken
    at most `max_passes` times its size, because no block is drawn more often.
    """
    sized = cut_lineage(docs.select("doc_id", "source", F.xxhash64("text").alias("mark"),
                                    word_count().alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, max_passes))
    streams = cut_lineage(stream_offsets(sized, targets))
    slots = drawn_blocks(draws(targets, seed, block, shard_blocks, max_passes), seed)
    times = (slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
             .select(F.col("source").alias("s"), F.col("block").alias("b"), "times"))
    row = ["doc_id", "mark", "source", "size", "source_size", "target"]
    # As many blocks as the corpus has, so never a broadcast.
    return (document_blocks(streams, block)
            .join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s"))
                  & (F.col("block") == F.col("b")), "left")
            .groupBy("start", *row)
            .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
            .select(*row, "taken")
            .unionByName(streams.filter("size = 0").select(
                *row, F.lit(0).cast("long").alias("taken"))))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    A document comes floor(taken / size) times, and once more with the probability of the
    remainder (a hash of its id and text decides, so reruns agree).
    """
    shares = mix(docs, seed).filter("taken > 0").select(
        F.col("doc_id").alias("d_"), F.col("mark").alias("m_"), F.col("source").alias("s_"),
        (F.col("taken") / F.col("size") + (F.xxhash64(F.lit(seed), "doc_id", "mark").bitwiseAND(
            F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))).cast("int").alias("copies_")) \
        .groupBy("d_", "m_", "s_").agg(F.max("copies_").alias("copies_"))
    return (packed(docs, "doc_id", "source", F.xxhash64("text").alias("mark"))
            .join(shares, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("mark") == F.col("m_"))
                  & F.col("source").eqNullSafe(F.col("s_")))
            .filter("copies_ > 0")
            .withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_"))))
            .select("record.*"))
