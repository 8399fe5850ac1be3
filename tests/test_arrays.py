import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import arrays
from tidewatch.sources.native import NATIVE_SCHEMAS, read_numbered

ODD = ['a } b', '{', '}}', '"quoted } text"', "back\\slash } \\", "line\nbreak {", "é漢😀}", "", "[,]", "x" * 300]


def records(n, seed):
    rng = random.Random(seed)
    return [dict(reviewId=f"g{i}", content=rng.choice(ODD) + rng.choice(ODD), score=str(1 + i % 5),
                 at="2026-08-01", extra={"nested": {"deep": rng.choice(ODD)}, "list": [{"a": "}"}, {}]})
            for i in range(n)]


@pytest.fixture
def block_size(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in names}

    def choose(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield choose
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size, indent", [(10 ** 9, None), (3000, 1), (400, None)])
def test_arrays_are_cut_at_objects_only(spark, tmp_path, block_size, size, indent):
    expected = []
    for f in range(3):
        part = records(25, f)
        expected += part
        (tmp_path / f"part-{f}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=f % 2 == 0))
    (tmp_path / "part-8.json").write_text("[]")
    (tmp_path / "part-9.json").write_text("")
    block_size(size)
    got = arrays.read_objects(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [json.loads(r.text) for r in got] == expected
    assert [r.ingest_seq for r in got] == list(range(75))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, block_size):
    path = tmp_path / "one.json"
    path.write_text(json.dumps(records(2000, 1)))
    block_size(path.stat().st_size // 20)
    pieces = arrays.pieces_of(spark, str(path))
    assert pieces.rdd.getNumPartitions() >= 10
    assert pieces.groupBy(F.spark_partition_id()).count().count() >= 10
    rows = read_numbered(spark, str(path), "google_play").orderBy("ingest_seq").collect()
    assert [r.content for r in rows] == [r["content"] for r in records(2000, 1)]
    assert rows[0].__fields__ == [*NATIVE_SCHEMAS["google_play"].fieldNames(), "ingest_seq"]


def test_objects_without_an_array(spark, tmp_path, block_size):
    part = records(10, 4)
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, part)) + "\n")
    block_size(200)
    got = arrays.read_objects(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [json.loads(r.text) for r in got] == part
