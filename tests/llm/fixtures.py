"""Small document tables with every odd case: nulls, empty and long texts, ties, repeats."""

import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that an operator might use for itself.
EXTRA = ("key", "size", "bucket", "group", "h", "node", "root", "start", "slot", "shard", "model",
         "target", "taken", "block", "n_words", "score", "verdict", "row", "class_id", "key_",
         "key__", "k_", "d_", "m_", "s_", "copies_", "copy_", "id_", "row_", "mark", "removed",
         "key_here", "id_kept", "key_kept", "nth", "other", "record", "hits__", "n_words__",
         "items__", "n_hit__", "same", "part", "parts", "order_key", "virtual_slot", "with.dot")


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sentence(seed, n):
    return " ".join(words(seed, n)) + "."


def plain_rows(n=40):
    return [(i, sentence(i, 30 + i % 50), "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(n)]


def odd_rows():
    base = sentence(1000, 120)
    edited = base.replace("w1", "x1", 1)
    return [
        (100, None, "en", "s0", None), (101, "", "en", "s0", 0), (102, "  \n \t\n", None, None, 6),
        (None, base, "en", "s1", 1), (None, None, None, None, None), (103, base, "en", "s1", 1),
        (104, base, "fr", None, 1), (105, edited, "en", "s1", 1), (105, edited, "en", "s1", 1),
        (106, sentence(7, 30_000), "en", "s2", 1), (107, "öäü 漢字 \U0001F600 " * 200, "de", "s2", 1),
        (108, "a", "en", "s3", 1), (109, "b " * 3000, "en", "s3", 1),
        (110, "line one here\n\nline one here\nother line of text", "en", "s3", 1)]


def frame(spark, rows, extra=True):
    """The rows as documents, with clashing extra columns of several types."""
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    ddl = DOCS + "".join(f", `{c}` {'string' if i % 2 else 'int'}" for i, c in enumerate(EXTRA))
    more = tuple(None if i % 3 == 0 else ("x" if i % 2 else 7) for i in range(len(EXTRA)))
    return spark.createDataFrame([(*r, *more) for r in rows], ddl)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def shingles(text, n=5):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    if len(w) < n:
        return Counter([tuple(w)] if w else [])
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def jaccard(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def classes(n, linked):
    """Least member of the component of each of 0..n-1."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def similar_pairs(sets, threshold):
    """All pairs of multisets with at least this Jaccard similarity, by brute force."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            holders[k].append(i)
    pairs = {(i, j) for who in holders.values() for i in who for j in who if i < j}
    return [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= threshold]


def shuffle_files(spark):
    manager = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_")}
