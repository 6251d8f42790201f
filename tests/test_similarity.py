"""Scores and ranks against a loop over pairs."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corrspark.functions.vectors import cosine, unit
from corrspark.operators import blocks, similarity

DIM = 5


def half_up(x):
    """Three places, exact halves away from zero (float noise set aside)."""
    return float(Decimal(repr(round(x, 9))).quantize(Decimal("0.001"), ROUND_HALF_UP))


def cos(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def data(seed=1):
    draw = random.Random(seed)
    vec = lambda: [draw.gauss(0, 1) for _ in range(DIM)]
    queries = [(f"q{i}", vec()) for i in range(12)]
    cat = []
    for p in range(7):
        cat += [(f"CAPEC-{p * 5}", "field", f"f{j}", vec()) for j in range(draw.randint(1, 4))]
        for s in range(draw.randint(0, 3)):
            cat += [(f"CAPEC-{p * 5}", "flow", f"{s}", vec()) for _ in range(draw.randint(1, 2))]
    return queries, cat


def brute(queries, cat, flow_weight=1, round_fields=True):
    out = {}
    for q, v in queries:
        finals = {}
        for p in {c[0] for c in cat}:
            fields = [cos(v, c[3]) for c in cat if c[0] == p and c[1] == "field"]
            fields = [half_up(x) for x in fields] if round_fields else fields
            steps = {}
            for c in cat:
                if c[0] == p and c[1] == "flow":
                    steps.setdefault(c[2], []).append(cos(v, c[3]))
            best = [max(s) if len(s) > 1 else max(s[0], 0) for s in steps.values()]
            flow = sum(best) / len(best) if best else 0
            flow = half_up(flow) if flow_weight > 1 else flow
            scores = fields + [flow] * (flow_weight if flow else 0)
            finals[p] = half_up(sum(scores) / len(scores))
        order = sorted(finals, key=lambda p: (-finals[p], int(p.split("-")[1])))
        for rank, p in enumerate(order, 1):
            out[q, p] = (finals[p], rank)
    return out


def frames(spark, queries, cat):
    return (spark.createDataFrame(queries, "cve_id string, vector array<double>"),
            spark.createDataFrame(cat, "capec_id string, kind string, slot string, vector array<double>"))


@pytest.mark.parametrize("options", [{}, {"flow_weight": 2, "round_fields": False}])
@pytest.mark.parametrize("limit", [1 << 27, 2000])
def test_scores_and_ranks(spark, options, limit):
    queries, cat = data()
    got = similarity.score_patterns(*frames(spark, queries, cat), limit=limit, **options)
    got = {(r["cve_id"], r["capec_id"]): (r["final_score"], r["rank"]) for r in got.collect()}
    want = brute(queries, cat, **options)
    assert got == want


@pytest.mark.parametrize("limit", [1 << 27, 2000])
def test_hits_top_and_wanted(spark, limit):
    queries, cat = data(2)
    q, c = frames(spark, queries, cat)
    hit = F.array(F.struct(F.lit("CAPEC-5").alias("capec_id"), F.lit(0.3).alias("score")))
    q = q.withColumn("hits", hit).withColumn("truth", F.array(F.lit("CAPEC-5"), F.lit("CAPEC-99")))
    whole = similarity.score_patterns(q, c, hits="hits", limit=limit).collect()
    base = {(r["cve_id"], r["capec_id"]): r for r in whole if r["model"] == "vector"}
    fused = {(r["cve_id"], r["capec_id"]): r for r in whole if r["model"] == "vector_keyword"}
    for key, row in fused.items():
        bonus = 0.3 if key[1] == "CAPEC-5" else -0.01
        assert row["final_score"] == pytest.approx(base[key]["final_score"] + bonus)
    for qid in {k[0] for k in fused}:
        order = sorted((k for k in fused if k[0] == qid), key=lambda k: (-fused[k]["final_score"], base[k]["rank"]))
        assert [fused[k]["rank"] for k in order] == list(range(1, len(order) + 1))
    top = similarity.score_patterns(q, c, hits="hits", top=2, limit=limit).collect()
    assert sorted(map(tuple, top)) == sorted(tuple(r) for r in whole if r["rank"] <= 2)
    some = similarity.score_patterns(q, c, wanted="truth", limit=limit).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in whole if r["capec_id"] == "CAPEC-5" and r["model"] == "vector")


def test_pieces_of_a_batch_agree(spark, monkeypatch):
    q, c = frames(spark, *data(4))
    whole = sorted(map(tuple, similarity.score_patterns(q, c).collect()))
    monkeypatch.setattr("corrspark.operators.blocks.CELLS", 50)
    for limit in (1 << 27, 2000):
        assert sorted(map(tuple, similarity.score_patterns(q, c, limit=limit).collect())) == whole


def test_column_cosine_agrees_with_blocks(spark):
    queries, cat = data(3)
    cat = [c for c in cat if c[1] == "field"]
    q, c = frames(spark, queries, cat)
    got = {(r["cve_id"], r["capec_id"], r["field"]): r["score"] for r in similarity.field_scores(q, c).collect()}
    pairs = [(a, p, s, va, vb) for a, va in queries for p, _, s, vb in cat]
    df = spark.createDataFrame(pairs, "a string, p string, s string, va array<double>, vb array<double>")
    for r in df.select("a", "p", "s", cosine(F.col("va"), F.col("vb")).alias("x"), cosine(unit(F.col("va")), F.col("vb")).alias("y")).collect():
        assert abs(got[r["a"], r["p"], r["s"]] - r["x"]) <= 0.0005 + 1e-9
        assert abs(r["x"] - r["y"]) < 1e-9 and -1 - 1e-9 <= r["x"] <= 1 + 1e-9


def test_zero_vector_scores_zero(spark):
    q = spark.createDataFrame([("q", [0.0, 0.0])], "cve_id string, vector array<double>")
    c = spark.createDataFrame([("CAPEC-1", "field", "f", [1.0, 0.0])], "capec_id string, kind string, slot string, vector array<double>")
    assert similarity.score_patterns(q, c).first()["final_score"] == 0.0


def test_step_texts_compat(spark, rows):
    steps = spark.createDataFrame(
        [("p", 0, "1", "look", ""), ("p", 1, "2", "", ""), ("p", 2, "3", "do", "with")],
        "capec_id string, pos int, step string, description_aggregated string, techniques_aggregated string",
    )
    assert rows(similarity.step_texts(steps), "slot", "text") == [("1", "look"), ("3", "do"), ("3", "with")]
    got = {(r["slot"], r["text"]) for r in similarity.step_texts(steps, compat=True).collect()}
    assert got == {("1", "look"), ("2", None)}


def test_wide_scores_and_models(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"], [[1.0, 0.0], [0.0, 1.0]])], "id int, q array<double>, n array<string>, v array<array<double>>")
    long_rows = similarity.one_to_many(df, "q", "n", "v", ["id"], "SBERT")
    assert similarity.wide_scores(long_rows, ["id"]).first()["scores"] == {"a_sbert_score": 1.0, "b_sbert_score": 0.0}
    bad = df.withColumn("n", F.array(F.lit("a")))
    with pytest.raises(Exception, match="same length"):
        similarity.one_to_many(bad, "q", "n", "v", ["id"]).collect()
    assert similarity.model_list(["A", "B", "A"]) == ["A", "B", "A_keyword", "B_keyword"]


@pytest.mark.parametrize("limit", [1 << 27, 2000])
def test_equal_and_missing_keys_and_vectors(spark, limit):
    queries, cat = data(6)
    rows = [("same", v) for _, v in queries] + [(None, v) for _, v in queries[:2]] + [("none", None)]
    cat = [*cat, ("CAPEC-5", "field", "zz", None), ("CAPEC-6", "flow", "zz", None)]
    q, c = frames(spark, rows, cat)
    hits = F.array(F.struct(F.lit("CAPEC-5").alias("capec_id"), F.lit(0.3).alias("score")))
    got = similarity.score_patterns(q.withColumn("hits", hits), c, hits="hits", limit=limit).collect()
    patterns = len({p for p, *_ in cat})
    count = {}
    for r in got:
        count[r["cve_id"], r["model"], r["rank"]] = count.get((r["cve_id"], r["model"], r["rank"]), 0) + 1
    for model in ("vector", "vector_keyword"):
        assert [count["same", model, k] for k in range(1, patterns + 1)] == [len(queries)] * patterns
        assert count[None, model, 1] == 2 and ("none", model, 1) not in count
    assert similarity.without_vector(q).collect() == [("none", "no vector")]


def test_a_key_larger_than_the_limit_is_an_error(spark):
    with pytest.raises(ValueError, match="limit"):
        similarity.score_patterns(*frames(spark, *data(1)), limit=10)


def clustered(n_clusters, per_cluster, dim=8, seed=5):
    """Patterns around a few directions that lie far apart."""
    pick = random.Random(seed)
    rows = []
    for c in range(n_clusters):
        for i in range(per_cluster):
            vector = [pick.gauss(0, 0.02) + (1.0 if d == c else 0.0) for d in range(dim)]
            rows += [(f"CAPEC-{c * per_cluster + i}", "field", f"f{k}", [x + pick.gauss(0, 0.01) for x in vector]) for k in range(2)]
    return rows


def test_blocks_that_no_row_needs_are_not_read(spark, monkeypatch):
    from pyspark.sql import DataFrame

    cat = clustered(8, 30)
    queries = [(f"q{i}", [0.01 * k + (1.0 if k == i % 2 else 0.0) for k in range(8)]) for i in range(6)]
    q, c = frames(spark, queries, cat)
    whole = sorted(tuple(r) for r in similarity.score_patterns(q, c, top=5).collect())
    # beyond the limit nothing of the catalogue is gathered as a table
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("the catalogue passed the driver"))
    assert sorted(tuple(r) for r in similarity.score_patterns(q, c, top=5, limit=12_000).collect()) == whole
    stored = blocks.catalogue_blocks(c, blocks.vector_bytes(F.col("vector")), "capec_id", 12_000, "vector")
    assert len(stored) > 6 and stored.centres is not None
    loaded = blocks.Loaded(stored, similarity.Catalogue)
    scorer = similarity._Scorer("cve_id", "vector", "vector", None, None, 1, True, False)
    batch = pd.DataFrame(queries, columns=["cve_id", "vector"])
    best = similarity.best_over_blocks(batch, loaded, scorer, 5)
    assert loaded.reads < len(stored) / 2
    assert sorted((batch["cve_id"][r["_at"]], r["capec_id"], r["rank"]) for _, r in best.iterrows()) == sorted((r[0], r[2], r[4]) for r in whole)


def test_bounds_hold(spark):
    queries, cat = data(9)
    q, c = frames(spark, queries, cat)
    stored = blocks.catalogue_blocks(c.filter("kind = 'field'"), blocks.vector_bytes(F.col("vector")), "capec_id", 1500, "vector")
    units = blocks.units_of([v for _, v in queries])
    bounds = stored.bounds(units)
    seen = set()
    for i in range(len(stored)):
        rows = stored.load(i)
        seen |= set(rows["capec_id"])
        assert ((units @ blocks.units_of(rows["vector"]).T).max(axis=1) <= bounds[:, i]).all()
    assert seen == {p for p, kind, *_ in cat if kind == "field"}


@pytest.mark.parametrize("limit", [1 << 27, 2000])
def test_scores_make_up_the_final_score(spark, limit):
    queries, cat = data(7)
    for options in ({}, {"top": 3}):
        for r in similarity.score_patterns(*frames(spark, queries, cat), limit=limit, scores=True, **options).collect():
            parts = [*r["field_scores"], *([] if r["execution_flow_score"] is None else [r["execution_flow_score"]])]
            assert len(r["fields"]) == len(r["field_scores"]) == len({s for p, k, s, _ in cat if p == r["capec_id"] and k == "field"})
            assert r["final_score"] == pytest.approx(sum(parts) / len(parts) if parts else 0.0, abs=0.0005 + 1e-9)
