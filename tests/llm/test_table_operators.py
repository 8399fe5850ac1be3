"""Sharding, mixing, quality, toxicity, URL verdicts and the pipeline."""

import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import frame, odd_rows, plain_rows, sentence, shuffle_files, words
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (
    bagminhash,
    common,
    decontaminate,
    mixing,
    quality,
    registry,
    sharding,
    toxicity,
    urlrank,
)

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
LABELS = "doc_id long, quality int, toxic int"


# --- sharding ------------------------------------------------------------------------

def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rows = plain_rows(3000) + odd_rows()
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert Counter((r.size, r.text_crc32) for r in got) == Counter(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    light = sorted(sizes.values())[:-1]  # one document of 30,000 words is a shard of its own
    assert max(light) - min(light) < 0.02 * max(light)


def test_equal_rows_are_spread_over_shards(spark):
    """A third of all rows are one row."""
    rows = plain_rows(600) + [(7, sentence(7, 60), "en", "s", 1)] * 300
    got = sharding.shard_documents(frame(spark, rows)).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 900 and len(sizes) == 16
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_stored_map_is_edited_for_new_loads(spark, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.shard_documents(frame(spark, plain_rows(400)), path=path)
    again = sharding.shard_documents(frame(spark, plain_rows(700)), path=path)
    assert {r.version for r in sharding.load_version(spark, path).collect()} == {2}
    old = {r.doc_id: r for r in first.collect()}
    new = {r.doc_id: r for r in again.collect()}
    assert all(old[i].virtual_slot == new[i].virtual_slot for i in old)
    sizes = Counter()
    for r in new.values():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * max(sizes.values())
    assert sum(old[i].shard == new[i].shard for i in old) > 0.8 * len(old)


def test_sharding_of_no_rows(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_map_versions_move_whole_slots_only_where_needed(spark, tmp_path):
    records = frame(spark, plain_rows(500)).select(
        F.length("text").alias("size"), sharding.virtual_slot(["doc_id"], 64).alias("virtual_slot"))
    loads = sharding.slot_loads(records, 64)
    path = str(tmp_path / "map")
    sharding.save_version(sharding.first_map(loads, 4), path)
    old = {r.virtual_slot: r for r in sharding.load_version(spark, path).collect()}
    sharding.save_version(sharding.rebalance(sharding.load_version(spark, path), loads, 5), path)
    new = {r.virtual_slot: r for r in sharding.load_version(spark, path).collect()}
    assert {r.version for r in new.values()} == {2} and set(new) == set(old) == set(range(64))
    assert {r.virtual_slot for r in sharding.load_version(spark, path, 1).collect()} == set(old)
    moved = sum(old[s].shard != new[s].shard for s in old)
    totals = Counter()
    for r in new.values():
        totals[r.shard] += r.bytes
    assert 0 < moved < 32 and len(totals) == 5
    assert max(totals.values()) - min(totals.values()) <= max(r.bytes for r in new.values())


# --- mixing --------------------------------------------------------------------------

def targets_by_force(sizes):
    """Shares by weight, the excess over three sizes reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= full
    return target | {s: level * weight[s] for s in free}


def test_targets_and_taken_words(spark):
    rows = [(i, sentence(i, 40), "en", f"s{i % 7}" if i % 11 else None, 0) for i in range(2000)]
    rows += [(9000 + i, sentence(i, 30), "en", "tiny", 0) for i in range(4)]
    rows += [(9100, None, "en", "empty", 0), (9101, "", "en", "empty", 0)]
    rows += [r for r in odd_rows() if r[0] != 106]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    target = targets_by_force(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 3 * mixing.BLOCK_WORDS), s
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_permutation_hits_every_index_once(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("s", F.lit("a"))
        got = [r[0] for r in df.select(mixing.permuted("id", "n", "s", 5)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 97 or got != list(range(n))


def test_drawn_counts_are_numbered_through_the_shards(spark):
    targets = spark.createDataFrame(
        [("a", 40_000, 90_000.0), ("b", 70_000, 10_000.0), (None, 10_000, 20_000.0)],
        "source string, source_size long, target double")
    drawn = mixing.draws(targets, 3).collect()
    assert drawn
    by = defaultdict(list)
    for r in drawn:
        by[r.source].append((r.first, r.taken, r.n_blocks))
    for parts in by.values():
        at = 0
        for first, taken, n in sorted(parts):
            assert first == at
            at += taken
        assert at <= 3 * n
    blocks = mixing.drawn_blocks(mixing.draws(targets, 3), 3)
    assert max(r["count"] for r in blocks.groupBy("source", "block").count().collect()) <= 3


def test_mixed_documents_keep_their_columns(spark):
    docs = frame(spark, plain_rows(60))
    got = mixing.mixed_documents(docs)
    assert got.schema == docs.schema
    copies = Counter(r.doc_id for r in got.collect())
    assert max(copies.values()) <= 3 and sum(copies.values()) > 20
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [(1, None, None, None, None)])).count() == 0


def test_draws_count_blocks_by_their_words(spark):
    """Blocks of a small source are shorter than 32 words, so more of them are drawn."""
    sizes = [(f"s{k}", 1.0, 100, 100.0) for k in range(30)]
    targets = spark.createDataFrame(
        sizes, "source string, weight double, source_size long, target double")
    drawn = sum(r.taken for r in mixing.draws(targets, 3).collect())
    assert abs(drawn * 25 - 3000) < 0.05 * 3000


# --- quality -------------------------------------------------------------------------

def kneser_ney_by_force(texts, order=4):
    """p(character | three before) by the recursion, with the discounts of each order."""
    grams = Counter()
    for t in texts:
        t = "\n" * (order - 1) + t
        grams.update(t[i:i + order] for i in range(len(t) - order + 1))
    levels = [grams]
    while len(next(iter(levels[0]))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    cuts = []
    for counts in levels:
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        cuts.append([max(0.1, min(k - 0.05, k - (k + 1) * y * n[k + 1] / max(n[k], 1)))
                     for k in (1, 2, 3)])

    def p(gram):
        out = 1 / 65536
        for k, (counts, d) in enumerate(zip(levels, cuts), 1):
            g = gram[-k:]
            same = {x: c for x, c in counts.items() if x[:-1] == g[:-1]}
            if not same:
                continue
            total = sum(same.values())
            gamma = sum(d[min(c, 3) - 1] for c in same.values()) / total
            c = counts.get(g, 0)
            out = (c - d[min(c, 3) - 1] if c else 0) / total + gamma * out
        return out

    return p


def test_log_probabilities_match_the_recursion(spark):
    texts = [sentence(i, 12) + " Straße" for i in range(6)]
    rows = spark.createDataFrame([("x", t) for t in texts], "model string, text string")
    tables = quality.kneser_ney(quality.gram_counts(rows))
    asked = spark.createDataFrame([("x", t) for t in (texts[0], "w1 w9 öö! zz")],
                                  "model string, text string")
    grams = quality.gram_counts(asked).select("model", "gram")
    p = kneser_ney_by_force([re.sub(r"\d", "0", t) for t in texts])
    got = quality.log_probabilities(grams, tables).collect()
    assert len(got) > 20
    for r in got:
        code = r.gram & (2**64 - 1)
        gram = "".join(chr(code >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
        assert r.logp == pytest.approx(np.log(p(gram)), rel=1e-9), gram


def test_perplexity_shards_add_up(spark):
    rows = frame(spark, plain_rows(12), False).select(
        F.col("doc_id").alias("key"), F.lit("x").alias("model"), "text")
    counts = quality.gram_counts(rows)
    scores = quality.log_probabilities(counts.select("model", "gram"), quality.kneser_ney(counts))
    one = dict(map(tuple, quality.perplexities(rows, scores).collect()))
    many = dict(map(tuple, quality.perplexities(rows, scores, shard_rows=60).collect()))
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k]) for k in one)


def quality_case(spark):
    good = [(2000 + i, sentence(i, 60), "en", "s", 0) for i in range(200)]
    bad = [(1000 + i, "".join(chr(33 + (i * 7 + k * k) % 60) for k in range(300)), "en", "s", 0)
           for i in range(20)]
    labels = [(2000 + i, 1, 0) for i in range(0, 200, 2)]
    labels += [(1000, 0, 0), (None, 1, 1), (2000, None, None)]
    return good, bad, spark.createDataFrame(labels, LABELS)


def test_quality_keeps_clean_and_rejects_noise(spark):
    good, bad, labels = quality_case(spark)
    got = {r.doc_id: r for r in quality.quality(frame(spark, good + bad), labels).collect()}
    assert sum(got[r[0]].accepted for r in good) >= 0.95 * len(good)
    assert not any(got[r[0]].accepted for r in bad)


def test_quality_keeps_a_language_with_few_trusted_rows(spark):
    """Its clean documents are held against the pooled model and that model's ceiling."""
    good, _, labels = quality_case(spark)
    rare = [(4000 + i, sentence(4000 + i, 60), "xx", "s", 0) for i in range(40)]
    labels = labels.union(spark.createDataFrame([(4000 + i, 1, 0) for i in range(8)], LABELS))
    got = {r.doc_id: r for r in quality.quality(frame(spark, good + rare), labels).collect()}
    assert sum(got[r[0]].accepted for r in rare) >= 0.9 * len(rare)


def test_quality_fits_on_all_trusted_rows(spark):
    good, bad, labels = quality_case(spark)
    docs = frame(spark, good + bad)
    others = spark.range(10 ** 9, 10 ** 9 + 400_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    result = lambda marks: {r.key: (pytest.approx(r.perplexity), pytest.approx(r.ceiling), r.accepted)
                            for r in quality.quality(docs, marks).collect()}
    assert result(labels) == result(labels.select("doc_id", "quality", "toxic").union(others))


def test_quality_of_odd_rows(spark):
    good, _, labels = quality_case(spark)
    docs = frame(spark, good + odd_rows())
    got = quality.quality(docs, labels).collect()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(good) + len(odd_rows()) - 1  # one repeated row
    assert of[100].perplexity is None and not of[100].accepted and not of[101].accepted
    kept = quality.accepted_documents(docs, labels)
    assert kept.schema == docs.schema
    assert kept.filter("doc_id = 105").count() == 2 * of[105].accepted
    assert quality.quality(frame(spark, []), labels).count() == 0
    none = quality.quality(frame(spark, odd_rows()), labels.limit(0)).collect()
    assert all(r.accepted == (r.perplexity is not None) for r in none)


# --- toxicity ------------------------------------------------------------------------

def test_toxicity_learns_planted_words_and_ignores_held_out_labels(spark):
    rows, labels = [], []
    for i in range(800):
        w = words(i, 60)
        toxic = i % 8 == 0
        if toxic:
            w[i % 50] = ("nastyword", "vileword")[i % 2]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity.classify(docs, table).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) > 0.97 * len(held)
    swapped = table.withColumn("toxic", F.when(F.expr(
        "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2"), 1 - F.col("toxic"))
        .otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(docs, swapped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(103, 1, 1), (103, 1, 0), (None, 1, 1), (104, 1, None)], LABELS)
    got = toxicity.classify(frame(spark, odd_rows()), labels).collect()
    assert len(got) == len(odd_rows())
    none = toxicity.classify(frame(spark, odd_rows()), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.classify(frame(spark, []), labels).count() == 0


# --- URL verdicts --------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_rules_fit_hosts_and_paths(spark):
    urls = {1: "https://A.Example.ORG/es/1?x", 2: "http://example.org/en/12", 3: "http://x.org",
            4: "http://x.org?q/", 5: "http://y.com/fr/1#a", 6: "http://y.com/de/", 7: None,
            8: "no scheme/org/", 9: "http://forg/es/", 10: "ftp://Z.com/", 11: "://org/a",
            12: "http://notexample.org/es/"}
    pages = spark.createDataFrame([(k, u, None) for k, u in urls.items()] * 2, PAGES)
    got = urlrank.judge(pages, urlrank.rule_table(spark)).collect()
    assert len(got) == 2 * len(urls)
    of = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert of == {
        1: ("a.example.org", "/es/1", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"),
        3: ("x.org", "", None), 4: ("x.org", "", None), 5: ("y.com", "/fr/1", "com/fr/"),
        6: ("y.com", "/de/", "com/de/"), 7: ("", "", None), 8: ("", "", None),
        9: ("forg", "/es/", None), 10: ("z.com", "/", None), 11: ("org", "/a", "org/"),
        12: ("notexample.org", "/es/", "org/")}


def test_ranks_match_power_iteration(spark):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "d", 1.0), ("c", "a", 1.0), ("e", "c", 1.0)]
    seeds = [("trust", "a", 1.0), ("trust", "b", 0.5), ("distrust", "d", 1.0)]
    got = {r.host: r for r in urlrank.propagate(
        spark.createDataFrame(links, "src string, dst string, weight double"),
        spark.createDataFrame(seeds, "kind string, host string, seed double")).collect()}
    names = "abcde"
    for kind, pick in (("trust", lambda s, d: (s, d)), ("distrust", lambda s, d: (d, s))):
        m, start = np.zeros((5, 5)), np.zeros(5)
        for s, d, w in links:
            x, y = pick(s, d)
            m[names.index(y), names.index(x)] += w
        for k, h, v in seeds:
            start[names.index(h)] += v * (k == kind)
        start /= start.sum()
        m[:, m.sum(axis=0) == 0] = start[:, None]  # a walk begins anew where there is no link
        m /= m.sum(axis=0)
        rank = np.linalg.solve(np.eye(5) - urlrank.DAMPING * m, start * (1 - urlrank.DAMPING))
        assert rank.sum() == pytest.approx(1)
        for i, n in enumerate(names):
            assert abs((getattr(got[n], kind) if n in got else 0) - rank[i]) < 4 * urlrank.TOLERANCE


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    page = lambda k, url, *to: (k, url, "".join(f'<a href="{t}">x</a>' for t in to))
    pages = spark.createDataFrame([
        page(1, "http://bad.com/de/1"), page(2, "http://good.org/1", "http://fine.net/"),
        page(3, "http://shady.net/1", "http://bad.com/de/1", "http://BAD.com/x"),
        page(4, "http://fine.net/2", "/local"), page(5, "http://lone.net/")], PAGES)
    got = {r.page_id: r.verdict for r in urlrank.judge(pages, urlrank.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert urlrank.judge(pages.limit(0), urlrank.rule_table(spark)).count() == 0


# --- pipeline ------------------------------------------------------------------------

@needs_data
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.schema, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns.fieldNames() and 0 < docs.count()
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()) \
        == Counter(r.doc_id for r in last.select("doc_id").collect())


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns with the names that operators use inside come out as they went in."""
    docs = frame(spark, plain_rows(30) + odd_rows())
    labels = spark.createDataFrame([], LABELS)
    items = spark.createDataFrame([(1, "absent words")], "item_id long, text string")
    extra = {tuple(r)[5:] for r in docs.collect()}
    for stage in (lambda d: quality.accepted_documents(d, labels), bagminhash.one_per_class,
                  lambda d: decontaminate.decontaminated(d, items), mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and {r[5:] for r in got} == extra
        assert {r[:5] for r in got} <= {tuple(r)[:5] for r in docs.collect()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_a_written_table_leaves_no_shuffle_files_and_takes_texts_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    settings, before = spark.conf.get(name), shuffle_files(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    texts = spark.range(0, 3000, 1, 2).repartition(2, "id").select(F.repeat(F.lit("x"), 10_000).alias("t"))
    table = common.cut_lineage(texts.mapInArrow(sizes, "n long"))
    n = [r.n for r in table.collect()]
    assert sum(n) == 3000 and max(n) * 10_000 < 5_000_000
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(name) == settings


def test_gram_counts_of_tasks_that_send_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(quality, "HELD_ROWS", 40)
    texts = [("ab"[i % 2], f"text {i % 9} " + "xyz "[: i % 5] * (i % 7)) for i in range(60)]
    monkeypatch.setattr(quality, "CHUNK_CHARS", 30)
    got = {(r.model, r.gram): r.c for r in quality.gram_counts(
        spark.createDataFrame(texts, "model string, text string").repartition(2)).collect()}
    want = Counter()
    for model, text in texts:
        want.update((model, g) for g in quality.gram_codes([text])[0].tolist())
    assert got == want
