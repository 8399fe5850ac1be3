"""Registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry_points
from tidewatch.params import ENGLISH_STOP_WORDS
from tidewatch.plans.oracle import ORACLE_SQL
from tidewatch.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(ORACLE_SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == expected


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stop_words_are_sparks_own(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 6


def test_planted_issues_reach_every_level(spark):
    levels = {r.issue_id: r.risk_level for r in QUERIES["rating_risk_tiers"](spark, FOLDER).collect()}
    assert set(levels.values()) == {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    assert QUERIES["warning_count_tiers"](spark, FOLDER).first()[0] == 2
    assert len(QUERIES["risk_level_filter_tiers"](spark, FOLDER).collect()) == len(levels) - 2
    rows = {r.issue_id: r for r in QUERIES["impact_table_tiers"](spark, FOLDER).collect()}
    assert rows["issue_rare"].sample_size < 5 and len({r.confidence_level for r in rows.values()}) > 1
