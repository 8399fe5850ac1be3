"""Language ID, hard negatives and ranked search."""

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import frame, odd_rows, plain_rows

from tidewatch.llm import bytegru, langid, negatives, ranked, registry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", ["op4_repeats", "op8_url_filter", "op12_hard_negatives", "op13_ranked_search"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


# --- ranked search -------------------------------------------------------------------

def terms(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def ranked_by_force(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in counts for w in c)
    texts = {}
    for i, t in dict.fromkeys(items):
        if t is not None:
            texts.setdefault(i, []).append(t)
    out = []
    for item, parts in texts.items():
        query = Counter(w for p in parts for w in terms(p))
        scored = []
        for (doc, c), n in zip(counts, sizes):
            m = 25 + (75 * n * n_docs) // max(1, length)
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w, k in query.items() if c[w])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings, block_terms", [(40, 10), (500_000, 200_000)])
def test_ranked_search_by_force(spark, monkeypatch, postings, block_terms):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 10 ** 9)
    docs = plain_rows(120) + odd_rows() + [(500 + k, "w1 w2 w2 same", "en", "s", 0) for k in range(40)]
    items = [(1, "w1 w2 w2 w3 Same"), (2, "W7 w9 w11 w400 zz"), (3, None), (4, ""), (5, "absent"),
             (6, "öäü 漢字"), (None, "w5 w6"), (1, "w1 w2 w2 w3 Same"), (2, "w12 w13"), (7, docs[3][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, n int, terms string")
    got = ranked.ranked(frame(spark, docs), table, 10, block_terms, postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == ranked_by_force([r[:2] for r in docs], items, 10)


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.ranked(frame(spark, []), items).count() == 0
    assert ranked.ranked(frame(spark, plain_rows(5)), items.limit(0)).count() == 0


# --- hard negatives ------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row int, v string, slot int, score long"


def vectors(n, width=12, seed=3, labels=10):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=width)
        rows.append((i, [float(v) for v in (x / np.linalg.norm(x)).astype(np.float32)], int(i % labels)))
    return rows


def negatives_by_force(rows, every, k):
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = tuple(max(-2 ** 24, min(2 ** 24, math.floor(256 * np.float64(np.float32(x))))) for x in v)
        clean[(i, (label + 1) % 10 if i % 7 == 0 else label, w)] = None
    anchors = {}
    for i, label, v in clean:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted({(-sum(x * y for x, y in zip(v, w)), i, lab == label) for i, lab, w in clean if i != a})
        for sp, p, _ in [s for s in scored if s[2]][:k]:
            held = [s for s in scored if not s[2] and -80 * sp <= -100 * s[0] <= -100 * sp][:k]
            out += [(a, p, r, s[1], -sp, -s[0]) for r, s in enumerate(held, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, sizes, tile", [(300, (4096, 4096), 256), (400, (37, 3), 2), (60, (4096, 4096), 256)])
def test_hard_negatives_by_force(spark, monkeypatch, n, sizes, tile):
    monkeypatch.setattr(negatives, "ROWS", sizes[0])
    monkeypatch.setattr(negatives, "ANCHORS", sizes[1])
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = vectors(n)
    rows += [(10_000 + i, rows[20][1], i % 3) for i in range(90)]  # one common vector, many ties
    rows += [rows[5], rows[20], (40, rows[41][1], 2), (None, rows[1][1], 1), (20_001, None, 1), (20_002, rows[1][1], None),
             (20_003, [*rows[1][1][:-1], float("nan")], 1), (20_004, [*rows[1][1][:-1], float("inf")], 1),
             (20_005, [*rows[1][1][:-1], None], 1), (20_006, rows[1][1][:5], 1), (20_007, [], 1), (-20, rows[8][1], 8),
             (20_020, [1e30] * 12, 4), (20_021, [1e30] * 12, 5)]
    table = spark.createDataFrame([(*r, 1, "x", None, 5) for r in rows], VECTORS)
    got = sorted(map(tuple, negatives.hard_negatives(table, every=20).collect()))
    assert got == negatives_by_force(rows, 20, 5) and len(got) > 100


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(
        rng.normal(size=(200, 6)) * 10.0 ** rng.integers(0, 7, (200, 1)))]
    rows += [(1000, [3e5, 0.0, 1.0], 1), (1001, [1e-3, 0.5, 2.0], 1), (1002, [4e5, 1.0, 2.0], 2)]
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v)) for i, v, _ in rows}
    label = {i: (lab + 1) % 10 if i % 7 == 0 else lab for i, _, lab in rows}
    expected = []
    for a in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(x * y for x, y in zip(whole[a], whole[i])), i) for i in whole if i != a)
        for p, i in [s for s in scored if label[s[1]] == label[a]][:5]:
            held = [s for s in scored if label[s[1]] != label[a] and -80 * p <= -100 * s[0] <= -100 * p][:5]
            expected += [(a, i, r, n, -p, -s) for r, (s, n) in enumerate(held, 1)]
    table = spark.createDataFrame([(*r, 1, "x", None, 5) for r in rows], VECTORS)
    got = sorted(map(tuple, negatives.hard_negatives(table, every=20).collect()))
    assert got == sorted(expected) and max(r[4] for r in got) > 2 ** 53


def test_scores_leave_no_64_bits():
    big = np.array([[2 ** 62, 3, -2 ** 40], [2 ** 62, 2 ** 62, 0], [7, 1, 5]])
    got = negatives.exact_scores(big, np.array([[1, 2 ** 61, 2 ** 20], [2, 2, 0], [1, 2, 3]]))
    assert got.tolist() == [2 ** 63 - 1, 2 ** 63 - 1, 24]


def test_hard_negatives_of_small_tables(spark):
    table = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(table).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, 0, "", 0, 0)], VECTORS)
    assert negatives.hard_negatives(one).count() == 0


@pytest.mark.parametrize("seed, level", [(0, 0.5), (1, 0.2), (2, 0.0), (3, 0.9)])
def test_threshold_join_loses_no_pair(seed, level):
    rng = np.random.default_rng(seed)
    x = rng.integers(-200, 200, (150, 37)) * (rng.random((150, 37)) < 0.6)
    a = x[:40]
    full = a @ x.T
    least = (level * np.abs(full).max(axis=1) * rng.random(40)).astype(np.int64)
    i, r, s = negatives.threshold_join(a, least, x)
    assert sorted(zip(i, r, s)) == sorted((p, q, full[p, q]) for p in range(40) for q in range(150)
                                          if full[p, q] >= least[p])


# --- language ------------------------------------------------------------------------

def test_gradient_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in bytegru.initial(3, 2).items()}
    data, length, row = bytegru.windows_of([b"abcabc", b"xy", b"abx"], 4)
    label = np.array([0, 1, 1])[row]
    _, grad = bytegru.gradient(p, data, length, label)
    for name in bytegru.PARTS:
        used = np.argwhere(np.abs(grad[name]) > 1e-4)
        for at in map(tuple, used[rng.permutation(len(used))[:6]]):
            loss = []
            for step in (1e-3, -1e-3):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                loss.append(bytegru.gradient(q, data, length, label)[0])
            assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=2e-4)


def test_windows_hold_every_byte_once():
    texts = [b"", b"a" * 130, b"xyz", b"0123456789" * 20]
    data, length, doc = bytegru.windows_of(texts, 64)
    assert list(length) == sorted(length, reverse=True)
    for k, t in enumerate(texts):
        assert Counter(t) == Counter(b for r in np.flatnonzero(doc == k) for b in data[r, :length[r]].tolist())


def test_labels_do_not_depend_on_what_shares_a_batch():
    p = bytegru.initial(4, 3)
    texts = [b"one two three " * 20, b"x", "äöü".encode() * 50]
    together = langid.document_probabilities(p, texts, 3)
    for k, t in enumerate(texts):
        assert langid.document_probabilities(p, [t], 3)[0] == pytest.approx(together[k], abs=1e-5)
    assert together.sum(axis=1) == pytest.approx(1, abs=1e-5)


@needs_data
def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.join(langid.identify(docs), "doc_id").filter("held_out AND text IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_odd_documents_and_no_training_rows(spark):
    docs = frame(spark, odd_rows() + plain_rows(60) + [(900, "123 456 ...", "en", "s", 0)])
    got = {}
    for r in langid.identify(docs, max_rows=20).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, r.score == 0))
    assert got[100] == got[101] == got[102] == got[900] == {("und", True)}
    assert got[106] <= {("de", False), ("en", False), ("fr", False)} and len(got[105]) == 1
    assert sum(1 for _ in langid.identify(docs.limit(0)).collect()) == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]
