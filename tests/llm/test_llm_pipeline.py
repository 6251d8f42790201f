"""The queries on the smallest tables, their SQL, and the pipeline stage by stage."""

import os

import pytest
from llm_cases import awkward, frame, prose

import corpus_pipeline
from check import TABLES, normal
from corrspark.llm import queries
from corrspark.session import materialise

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
#: The table that a query has a row for each row of; phrases, ranks, pairs and turns have none.
ROWS = {"op3_chat_format": None, "op6_url_filter": "pages", "op10_decontaminate": None, "op11_collocations": None, "op13_lexical_search": None}


@tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toArrow().to_pandas()
    if name in queries.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        db = duckdb.connect()
        for table in TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        want = db.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    if ROWS.get(name, "documents"):
        assert len(got) == spark.read.parquet(f"{FOLDER}/{ROWS.get(name, 'documents')}.parquet").count()


@tables
@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_url_filter", "op8_mixing", "op12_pii"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))


def stages_by_hand(spark, docs):
    return {name: (docs := materialise(stage(spark, docs, FOLDER), name)) for name, stage in corpus_pipeline.STAGES}


@tables
def test_stages_act_on_what_is_left(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    base = prose(77, 200)
    planted = spark.createDataFrame([
        (9_000_001, base, "en", "src1", 1), (9_000_002, base.replace("the", "the", 1) + " end", "en", "src1", 1), (9_000_003, base, "en", "src2", 1),
        (9_000_004, prose(78, 50) + " " + item + " " + prose(79, 50), "en", "src1", 1), (9_000_005, "12 34 !!", "en", "src1", 1), (9_000_006, None, None, None, None),
    ], given.schema)
    docs = given.union(planted)
    out = stages_by_hand(spark, docs)
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in out.items()}
    kept = {name: {i for i in v if i > 9_000_000} for name, v in ids.items()}
    assert kept["language_id"] == {9_000_001, 9_000_002, 9_000_003, 9_000_004}
    assert kept["near_dedup"] == {9_000_001, 9_000_004}
    assert kept["decontaminate"] == {9_000_001}
    assert set(ids["mixing"]) <= set(ids["decontaminate"]) and len(ids["mixing"]) > len(set(ids["mixing"]))
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    assert all(df.columns == docs.columns for name, df in out.items() if name != "sharding")


def test_stages_take_awkward_and_empty_tables(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    out = stages_by_hand(spark, frame(spark, awkward(), clashes=True))
    left = {r["doc_id"] for r in out["near_dedup"].collect()}
    assert {4, 6, 9, 14, None} <= left and not {7, 8} & left
    assert out["sharding"].count() == out["mixing"].count() > 0
    assert all(df.count() == 0 for df in stages_by_hand(spark, frame(spark, [])).values())


@tables
def test_run_equals_the_stages(spark):
    want = stages_by_hand(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))["sharding"]
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(want.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "sharding"]
