import math

import pytest

from corrspark.operators import evaluate
from test_similarity import half_up

RANKS = [1, 4, 5, 6]


def at_k(spark, ranks, **options):
    df = spark.createDataFrame([("m", "q", r) for r in ranks], "model string, cve_id string, rank int")
    return {r["k"]: r for r in evaluate.metrics_at_k(df, 20, **options).collect()}


def test_golden(spark):
    got = at_k(spark, RANKS)
    recall = {1: 0.25, 5: 0.75, 10: 1.0, 20: 1.0}
    for k, want in recall.items():
        precision = half_up(sum(1 / k for r in RANKS if r <= k) / 4)
        assert got[k]["n"] == 4
        assert got[k]["recall"] == want
        assert got[k]["precision"] == precision
        assert got[k]["mrr"] == half_up(sum(1 / r for r in RANKS if r <= k) / 4)
        assert got[k]["f1"] == pytest.approx(half_up(2 * precision * want / (precision + want)))
        assert got[k]["ndcg"] == pytest.approx(half_up(sum(1 / math.log2(r + 1) for r in RANKS if r <= k) / 4))
    assert all(got[k]["recall"] <= got[k + 1]["recall"] for k in range(1, 20))


def test_nulls_and_other_denominator(spark):
    assert at_k(spark, [1, None])[1]["recall"] == 1.0
    pairs = spark.createDataFrame([("m", 2)], "model string, pairs long")
    assert at_k(spark, [1, None], pairs=pairs)[1]["recall"] == 0.5
    assert at_k(spark, [None]) == {}


def test_ranks_beyond_the_grid(spark):
    got = at_k(spark, [25])
    assert got[20]["recall"] == 0.0 and got[20]["f1"] == 0.0 and got[20]["ndcg"] == 0.0


def test_overall(spark):
    df = spark.createDataFrame([("m", r) for r in RANKS], "model string, rank int")
    row = evaluate.overall(df).first()
    assert (row["mrr"], row["mean_rank"]) == (half_up(sum(1 / r for r in RANKS if r) / 4), 4.0)


def test_report_keeps_missing_pairs(spark, rows):
    ranked = spark.createDataFrame([("CVE-2020-10", "CAPEC-1", "A", 2), ("CVE-2019-9", "CAPEC-2", "A", 1)], "cve_id string, capec_id string, model string, rank int")
    truth = spark.createDataFrame([("CVE-2020-10", "CAPEC-1"), ("CVE-2020-10", "CAPEC-7"), ("CVE-2019-9", "CAPEC-2"), ("CVE-1999-1", "CAPEC-1")], "cve_id string, capec_id string")
    names = spark.createDataFrame([("CAPEC-1", "One"), ("CAPEC-2", "Two")], "id string, name string")
    report = evaluate.rank_report(ranked, truth, names, ["A", "B"])
    got = [tuple(r) for r in evaluate.ordered_report(report).collect()]
    assert got == [
        ("CVE-2019-9", "CAPEC-2", "Two", 1, None),
        ("CVE-2020-10", "CAPEC-1", "One", 2, None),
        ("CVE-2020-10", "CAPEC-7", "Unknown CAPEC", None, None),
    ]
    assert tuple(evaluate.report_totals(report, truth).first()) == (3, 2, 3)
    stats = {r["model"]: r for r in evaluate.report_stats(report, ["A", "B"]).collect()}
    assert stats["A"]["mrr"] == 0.75 and stats["A"]["recall_at_1"] == 0.5
