"""Every named query against its SQL twin, and the shape of key plans."""

import os

import pytest

import registry
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, FOLDER).toArrow().to_pandas()
    if name in registry.ORACLES:
        want = db.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got.columns) > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_all_pairs_join(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cosine_rank_is_one_map(spark):
    from corrspark.operators import similarity
    from registry.scores import catalogue, queries_of

    text = plan(similarity.score_patterns(queries_of(spark, FOLDER), catalogue(spark, FOLDER)))
    assert "Exchange" not in text and "embedding:array" in text and "label" not in text


def test_search_reaches_the_scan(spark):
    assert "StringStartsWith(c_name" in plan(registry.QUERIES["search_prefix"](spark, FOLDER))


def test_tops_are_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["sample_per_year"](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["top_links_all_time"](spark, FOLDER))
