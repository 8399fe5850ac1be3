import json
import os
import random
from datetime import date, datetime, timedelta

import pytest
from helpers import review, rows, standard
from pyspark.sql import functions as F

from tidewatch.operators.clean import build_cleaned
from tidewatch.operators.trends import build_issue_trends
from tidewatch.params import TrendParams
from tidewatch.sources.native import Source
from tidewatch.sources.store import ReviewStore
from tidewatch.streaming import counts, ingest

FIELDS = ("review_id", "review_text", "cleaned_text", "rating", "review_day", "word_count")


def deliver(folder, name, records, age):
    """A file of native records that was changed `age` seconds ago."""
    path = folder / name
    path.write_text("\n".join(json.dumps(r) for r in records))
    at = datetime.now().timestamp() - age
    os.utime(path, (at, at))


def native(i, text, score="2", day="2026-05-04"):
    return dict(reviewId=i, content=text, score=score, at=f"{day} 10:00:00", appVersion="1")


def listen(spark, folder, store, state):
    source = Source("google_play", "com.x", "X", str(folder), multi_line=False)
    ingest.ingest_stream(ingest.stream_native(spark, source, files_per_batch=1), store, "gp",
                         str(state)).awaitTermination()


def test_files_that_arrive_late_or_twice(spark, tmp_path):
    folder, store = tmp_path / "in", ReviewStore(spark, str(tmp_path / "s"))
    folder.mkdir()
    first = [native("a", "first a"), native("b", "bad date", day="2026-13-40"), native("c", "first c"),
             native("c", "a later c in one file", score="1")]
    deliver(folder, "1.json", first, 500)
    deliver(folder, "2.json", [native("a", "second a"), native("b", "b with a date"), native("d", "new d")], 400)
    listen(spark, folder, store, tmp_path / "state")
    assert store.row_count("raw_reviews") == 7
    # A file again under another name, and reviews of long ago that come now.
    deliver(folder, "3.json", first, 300)
    deliver(folder, "4.json", [native("old", "very late", day="2001-01-01"), native("d", "second d")], 200)
    listen(spark, folder, store, tmp_path / "state")
    got = {r["review_id"]: r["review_text"] for r in rows(store.read("cleaned_reviews"))}
    assert got.keys() == {"a", "c", "d", "old"} and got["a"] == "first a" and got["d"] == "new d"
    assert store.row_count("raw_reviews") == 9
    version = store.state("raw_reviews").version
    listen(spark, folder, store, tmp_path / "state")  # nothing new
    assert store.state("raw_reviews").version == version


def test_a_batch_that_is_repeated_adds_nothing(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    batch = standard(spark, [review(review_id=f"r{i % 7}", review_text=f"text {i}") for i in range(10)])
    for _ in range(2):
        ingest.store_batch(store, batch, "w", 0)
        assert store.row_count("cleaned_reviews") == 7 and store.row_count("raw_reviews") == 10


def test_a_batch_that_failed_between_its_writes_is_finished(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    append = store.append

    def fails(table, *rest):
        if table == "raw_reviews":
            raise OSError("lost")
        return append(table, *rest)

    batch = standard(spark, [review(review_id=f"r{i}") for i in range(5)])
    store.append = fails
    with pytest.raises(OSError):
        ingest.store_batch(store, batch, "w", 0)
    store.append = append
    ingest.store_batch(store, batch, "w", 0)
    assert store.row_count("cleaned_reviews") == store.row_count("raw_reviews") == 5


def test_stream_equals_batch(spark, tmp_path):
    records = [review(review_id=f"r{i % 40}", review_text=f"text {i}" if i % 9 else " ",
                      rating=1 + i % 7, review_date=f"2026-0{1 + i % 8}-11") for i in range(100)]
    std = standard(spark, records)
    store = ReviewStore(spark, str(tmp_path / "s"))
    for k in range(4):
        ingest.store_batch(store, std.filter(F.col("ingest_seq").between(25 * k, 25 * k + 24)), "w", k)
    take = lambda df: sorted(map(str, df.select(*FIELDS).collect()))
    assert take(store.read("cleaned_reviews")) == take(build_cleaned(std))


def assigned(seed, n=400):
    """Reviews of 14 weeks; one issue is seen in the last weeks only."""
    rng, out = random.Random(seed), []
    for i in range(n):
        week = rng.choice([0, 1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 13])
        issue = rng.choice(["a", "b", None, "late" if week > 10 else "a"])
        at = datetime(2026, 3, 2) + timedelta(days=7 * week + rng.randrange(7), hours=rng.randrange(24))
        out.append((f"r{i}", at, rng.choice([1, 2, 3, 5, None]), issue))
    return out


@pytest.mark.parametrize("freq, seed", [("W", 1), ("D", 2)])
def test_series_of_a_stream_equal_those_of_a_batch(spark, tmp_path, freq, seed):
    data, ddl = assigned(seed), "review_id string, review_date timestamp_ntz, rating int, issue_id string"
    table = spark.createDataFrame(data, ddl)
    params = TrendParams(freq=freq)
    shuffled = random.Random(seed).sample(data, len(data))
    folder, store = tmp_path / "in", ReviewStore(spark, str(tmp_path / "s"))
    for k in range(4):
        spark.createDataFrame(shuffled[k::4], ddl).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(folder))
    counts.trends_stream(stream, store, "t", str(tmp_path / "state"), params, "3650 days").awaitTermination()
    assert store.state("issue_trends").version >= 1
    expected = rows(build_issue_trends(table, table.filter("issue_id IS NOT NULL"), params))
    key = lambda r: (r["issue_id"], r["date"])
    got = sorted(rows(store.read("issue_trends")), key=key)
    expected = sorted(expected, key=key)
    assert [key(r) for r in got] == [key(r) for r in expected]
    for a, b in zip(got, expected):
        assert a == pytest.approx(b, nan_ok=True) or {k: v for k, v in a.items() if v is None} == {
            k: v for k, v in b.items() if v is None} and all(
            a[k] == b[k] or a[k] == pytest.approx(b[k]) for k in a if a[k] is not None)


def test_only_periods_in_reach_are_computed_anew():
    dates = [date(2026, 1, 1) + timedelta(days=k) for k in range(20)]
    assert counts.touched_range(dates, [dates[8]], 4) == (dates[4], dates[8], dates[12])
    assert counts.touched_range(dates, [dates[1], dates[18]], 4) == (dates[0], dates[1], dates[19])


def test_an_update_leaves_other_months_alone(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    ddl = "date date, issue_id string, mention_count long, rating_sum long, rated_count long, negative_count long"
    first = spark.createDataFrame([(date(2026, m, 5), i, 3, 6, 3, 1) for m in range(1, 9) for i in ("a", None)], ddl)
    params = TrendParams(freq="D", rolling_periods=2)
    counts.update_trends(store, first, params, "t", 0)
    before = {b.id for b in store.state("issue_trends").batches}
    counts.update_trends(store, spark.createDataFrame([(date(2026, 8, 5), "a", 9, 9, 9, 9)], ddl), params, "t", 1)
    kept = next(b for b in store.state("issue_trends").batches if b.id in before)
    assert kept.months == tuple(f"2026-0{m}" for m in range(1, 8))
    assert rows(store.read("issue_trends", months=["2026-08"]))[0]["mention_count"] == 9
    counts.update_trends(store, first, params, "t", 1)  # a repeated number
    assert rows(store.read("issue_trends", months=["2026-08"]))[0]["mention_count"] == 9


def test_unknown_width_of_periods(spark):
    with pytest.raises(ValueError):
        counts.stream_counts(spark.range(1).selectExpr("id"), "M")


def test_the_state_is_on_disk_and_settings_are_as_before(spark, tmp_path):
    before = {n: spark.conf.get(n, None) for n in ingest.STATE_ON_DISK}
    folder, store = tmp_path / "in", ReviewStore(spark, str(tmp_path / "s"))
    folder.mkdir()
    deliver(folder, "1.json", [native("a", "first a"), native("a", "first a"), native("b", "b")], 500)
    source = Source("google_play", "com.x", "X", str(folder), multi_line=False)
    query = ingest.ingest_stream(ingest.stream_native(spark, source), store, "gp", str(tmp_path / "state"))
    query.awaitTermination()
    operator = next(p for p in query.recentProgress if p["numInputRows"])["stateOperators"][0]
    assert any(n.startswith("rocksdb") for n in operator["customMetrics"])
    assert store.row_count("raw_reviews") == 2
    assert {n: spark.conf.get(n, None) for n in ingest.STATE_ON_DISK} == before
