"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces.

Empty lines end sections (a line of blanks is a paragraph, so its blanks are hashed), line
ends end paragraphs, and a paragraph's leaves are pieces of at most `PIECE` characters that
also end with a sentence. A node is the hash of its
children's hashes, so equal roots mean equal structure and text, and unequal branches lead
to the places of an edit. The fingerprint is the tree written in preorder: R<root>,
S<section>, P<paragraph>, then the paragraph's leaves shortened to 8 hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import shuffle_parts

PIECE = 24
INTERVALS, BUCKET_ROWS = 256, 256


def fingerprint(text: str, piece: int = PIECE) -> Column:
    """Fingerprint of a text column, which must not be null."""
    leaf = rf"[^.!?]{{1,{piece}}}[.!?]*|[.!?]+"
    return F.expr(f"""
      transform(array(transform(split({text}, '\\n\\n'), section ->
        transform(array(transform(split(section, '\\n'), paragraph ->
          transform(array(transform(regexp_extract_all(paragraph, '(?s){leaf}', 0),
                                    x -> hex(xxhash64(x)))), leaves ->
            named_struct('hash', md5(array_join(leaves, ',')), 'tree', array_join(
              transform(leaves, x -> lpad(right(x, 8), 8, '0')), ' ')))[0])), paragraphs ->
          named_struct('hash', md5(array_join(transform(paragraphs, p -> p.hash), ',')),
            'tree', array_join(transform(paragraphs, p -> concat('P', p.hash, ' ', p.tree)),
                               ' ')))[0])), sections ->
        concat('R', md5(array_join(transform(sections, s -> s.hash), ',')), ' ', array_join(
          transform(sections, s -> concat('S', s.hash, ' ', s.tree)), ' ')))[0]""")


def leaves(mark: str) -> str:
    return f"filter(split({mark}, ' '), x -> length(x) = 8)"


def likeness(a: str, b: str) -> Column:
    """Share of leaves that two fingerprints have in common, 0 to 1.

    1 for equal roots; else distinct common leaves by the larger number of distinct leaves.
    """
    return F.expr(f"""
      IF({a} = {b}, 1D, transform(array(named_struct(
          'a', array_distinct({leaves(a)}), 'b', array_distinct({leaves(b)}))), s ->
        size(array_intersect(s.a, s.b)) / CAST(greatest(size(s.a), size(s.b), 1) AS DOUBLE))[0])""")


def changed_paragraphs(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs of `a` whose branch does not occur in `b`."""
    branches = "filter(split({}, ' '), x -> startswith(x, 'P'))"
    return F.expr(f"""
      transform(array(named_struct('a', {branches.format(a)}, 'b', {branches.format(b)})), s ->
        filter(sequence(0, size(s.a) - 1), i -> NOT array_contains(s.b, s.a[i])))[0]""")


def _buckets(docs: DataFrame) -> DataFrame:
    """Add i and s: places in descending order of doc_id, each of a few hundred rows.

    Quantiles of doc_id give `INTERVALS` intervals; each is cut evenly by value into as
    many buckets as its share of rows needs. Only the quantiles come to the driver. Null
    ids follow all others, spread by the text's hash. Neither column can be null, so that
    joins on them add no filter and all readers share one shuffle.
    """
    at = [k / INTERVALS for k in range(INTERVALS + 1)]
    stats = docs.agg(F.percentile_approx("doc_id", at, 4 * INTERVALS).alias("q"),
                     F.count(F.lit(1)).alias("n")).first()
    points = stats.q or [0] * (INTERVALS + 1)
    parts = max(1, -(-stats.n // (INTERVALS * BUCKET_ROWS)))
    spread = max(1, -(-stats.n // BUCKET_ROWS))
    q = "array(" + ", ".join(f"{int(p)}L" for p in points) + ")"
    inner = "array(" + ", ".join(f"{int(p)}L" for p in points[1:-1]) + ")"
    return (docs
            .withColumn("i", F.expr(f"IF(doc_id IS NULL, -1, size(filter({inner}, b -> b < doc_id)))"))
            .withColumn("s", F.expr(f"""coalesce(
                CASE WHEN doc_id IS NULL THEN pmod(xxhash64(text), {spread})
                     WHEN {q}[i + 1] <= {q}[i] THEN 0L
                     ELSE CAST(greatest(0D, least({parts} - 1D, floor((doc_id - {q}[i])
                       / CAST({q}[i + 1] - {q}[i] AS DOUBLE) * {parts}))) AS BIGINT) END, 0L)""")))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint with the next document's text and fingerprint.

    The next is by descending doc_id; after the last comes the first. Texts are shuffled
    once, to the buckets of `_buckets`; a bucket's last row takes its successor from the
    heads of the buckets, an interval's last bucket from the heads of the intervals.
    """
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = _buckets(rows).withColumn("h", F.xxhash64("text")).repartition(parts, "i", "s")
    order = (F.desc_nulls_last("doc_id"), F.desc("h"))
    inside = Window.partitionBy("i", "s").orderBy(*order)
    entry = F.struct("text", "fingerprint")
    chained = (placed.withColumn("fingerprint", fingerprint("text"))
               .withColumn("follower", F.lead(entry).over(inside)))
    heads = (placed.withColumn("place", F.row_number().over(inside)).filter("place = 1")
             .withColumn("fingerprint", fingerprint("text"))
             .select("i", "s", entry.alias("head")))
    across = Window.partitionBy("i").orderBy(F.desc("s"))
    heads = (heads.withColumn("follower", F.lead("head").over(across))
             .withColumn("place", F.row_number().over(across)))
    intervals = Window.orderBy(F.desc("i"))  # one row per interval
    tops = (heads.filter("place = 1").select(
        "i", F.coalesce(F.lead("head").over(intervals), F.first("head").over(intervals))
        .alias("after")))
    after = heads.join(tops, "i").select(
        "i", "s", F.coalesce("follower", "after").alias("after"))
    return (chained.join(after, ["i", "s"])
            .withColumn("next", F.coalesce("follower", "after"))
            .select("doc_id", "text", "fingerprint", F.col("next.text").alias("next_text"),
                    F.col("next.fingerprint").alias("next_fingerprint")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are.

    In the edited text the last third of the characters is replaced by as many first
    characters of the next document. A null text counts as empty; an empty text has a
    root and no leaves. Repeated ids follow each other by the text's hash, null ids come
    last; a single document is its own next one. Other columns are not read.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, changed_paragraphs (places of the edit in the old text).
    """
    linked = (with_next(docs)
              .withColumn("n_chars", F.char_length("text").cast("long"))
              .withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
              .withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - cut AS INT)), "
                                           "substring(next_text, 1, cut))"))
              .withColumn("edited_fingerprint", fingerprint("edited")))
    return linked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        changed_paragraphs("fingerprint", "edited_fingerprint").alias("changed_paragraphs"))
