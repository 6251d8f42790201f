"""Rank quality: every vector's own label is its true pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.operators import evaluate, tasks
from registry.base import query, table
from registry.scores import MODELS, RANKED, patterns, ranked


def truth(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("cve_id"), F.concat(F.lit("CAPEC-"), "label").alias("capec_id"))


def ranks(spark, folder):
    """Rank of each vector's own label; nothing else leaves the scoring tasks."""
    return ranked(spark, folder, true_only=True)


TRUE_RANKS = RANKED + """,
truth AS (SELECT vec_id AS cve_id, 'CAPEC-' || label AS capec_id FROM embeddings),
ranks AS (SELECT r.cve_id, r.capec_id, model, rank FROM ranked r JOIN truth t ON t.cve_id = r.cve_id AND t.capec_id = r.capec_id)"""
AT_K = TRUE_RANKS + """,
grid AS (
  SELECT model, k, count(*) AS n, count(*) FILTER (rank <= k) AS hits,
         coalesce(sum(1.0::DOUBLE / rank) FILTER (rank <= k), 0) AS rr,
         coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= k), 0) AS gain
  FROM ranks, (SELECT unnest(range(1, 21)) AS k) GROUP BY ALL),
prec AS (SELECT *, hits / n AS r, floor(1000.0::DOUBLE * hits / (n * k) + 0.5) / 1000 AS p FROM grid),
metrics AS (
  SELECT model, k, n, floor(1000.0::DOUBLE * hits / n + 0.5) / 1000 AS recall, p AS precision,
         round(rr / n, 3) AS mrr, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 3) ELSE 0 END AS f1,
         round(gain / n, 3) AS ndcg FROM prec)"""


@query("truth_ranks", f"WITH {TRUE_RANKS} SELECT * FROM ranks")
def truth_ranks(spark, folder):
    """The same ranks by a join of stored results with a ground truth."""
    return evaluate.truth_ranks(ranked(spark, folder, true_only=True), truth(spark, folder))


@query("rank_metrics", f"WITH {AT_K} SELECT * FROM metrics")
def rank_metrics(spark, folder):
    return evaluate.metrics_at_k(ranks(spark, folder))


def _register_metric(name: str, metric: str) -> None:
    @query(name, f"WITH {AT_K} SELECT model, k, {metric} FROM metrics")
    def run(spark, folder):
        return evaluate.metrics_at_k(ranks(spark, folder)).select("model", "k", metric)


for _name, _metric in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("mrr_at_k", "mrr"), ("f1_at_k", "f1"), ("ndcg_at_k", "ndcg")):
    _register_metric(_name, _metric)


@query("mrr", f"WITH {TRUE_RANKS} SELECT model, count(*) AS n, round(sum(1.0::DOUBLE / rank) / count(*), 3) AS mrr FROM ranks GROUP BY ALL")
def mrr(spark, folder):
    return evaluate.overall(ranks(spark, folder)).select("model", "n", "mrr")


@query("mean_rank", f"WITH {TRUE_RANKS} SELECT model, floor(1000.0::DOUBLE * sum(rank) / count(*) + 0.5) / 1000 AS mean_rank FROM ranks GROUP BY ALL")
def mean_rank(spark, folder):
    return evaluate.overall(ranks(spark, folder)).select("model", "mean_rank")


@query("recall_over_rows", f"""
WITH {TRUE_RANKS}, seen AS (SELECT model, CASE WHEN rank <= 8 THEN rank END AS rank FROM ranks)
SELECT model, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall FROM seen GROUP BY ALL
""")
def recall_over_rows(spark, folder):
    """Ranks beyond the eighth count as missing: they stay in the denominator."""
    rows = ranks(spark, folder).withColumn("rank", F.when(F.col("rank") <= 8, F.col("rank")))
    return evaluate.recall_over_rows(rows, 5).select("model", F.round("recall", 6).alias("recall"))


@query("chart_recall", f"""
WITH {TRUE_RANKS}, first_model AS (SELECT count(*) AS total FROM ranks WHERE model = 'vector')
SELECT model, k, round(count(*) FILTER (rank <= k)::DOUBLE / any_value(total), 6) AS recall
FROM ranks, first_model, (SELECT unnest(range(1, 21)) AS k) GROUP BY model, k
""")
def chart_recall(spark, folder):
    out = evaluate.chart_recall(ranks(spark, folder), first_model="vector")
    return out.select("model", "k", F.round("recall", 6).alias("recall"))


@query("set_precision", f"""
WITH {TRUE_RANKS} SELECT r.cve_id, r.model, count(t.capec_id)::DOUBLE / 3 AS precision
FROM ranked r LEFT JOIN truth t ON t.cve_id = r.cve_id AND t.capec_id = r.capec_id WHERE rank <= 3 GROUP BY ALL
""")
def set_precision(spark, folder):
    return evaluate.set_precision(ranked(spark, folder, top=3), truth(spark, folder), 3)


@query("mean_set_precision", f"""
WITH {TRUE_RANKS}, p AS (SELECT r.cve_id, r.model, count(t.capec_id)::DOUBLE / 3 AS precision
FROM ranked r LEFT JOIN truth t ON t.cve_id = r.cve_id AND t.capec_id = r.capec_id WHERE rank <= 3 GROUP BY ALL)
SELECT model, round(avg(precision), 6) AS precision FROM p GROUP BY ALL
""")
def mean_set_precision(spark, folder):
    out = evaluate.mean_set_precision(ranked(spark, folder, top=3), truth(spark, folder), 3)
    return out.select("model", F.round("precision", 6).alias("precision"))


_cuts = ", ".join(f"max(CASE WHEN k = {k} THEN value END) AS at_{k}" for k in evaluate.CUTS)


@query("metric_cuts", f"""
WITH {AT_K}, long AS (UNPIVOT (SELECT model, k, recall, precision, mrr, f1, ndcg FROM metrics) ON recall, precision, mrr, f1, ndcg INTO NAME metric VALUE value)
SELECT model, metric, {_cuts} FROM long GROUP BY model, metric
""")
def metric_cuts(spark, folder):
    return evaluate.metric_cuts(ranks(spark, folder))


def report_truth(spark, folder):
    """True pairs plus one pair per query that no model ranks."""
    pairs = truth(spark, folder)
    return pairs.unionByName(pairs.select("cve_id", F.lit("CAPEC-77").alias("capec_id")))


def report(spark, folder):
    return evaluate.rank_report(ranked(spark, folder, true_only=True), report_truth(spark, folder), patterns(spark, folder), MODELS)


REPORT = TRUE_RANKS + """,
pairs AS (SELECT * FROM truth UNION ALL SELECT cve_id, 'CAPEC-77' FROM truth),
report AS (
  SELECT p.cve_id, p.capec_id, CASE WHEN p.capec_id = 'CAPEC-77' THEN 'Unknown CAPEC' ELSE 'Pattern ' || split_part(p.capec_id, '-', 2) END AS capec_name,
         max(CASE WHEN model = 'vector' THEN rank END) AS vector_rank, max(CASE WHEN model = 'vector_keyword' THEN rank END) AS vector_keyword_rank
  FROM pairs p LEFT JOIN ranked r ON r.cve_id = p.cve_id AND r.capec_id = p.capec_id GROUP BY ALL)"""


@query("rank_report", f"WITH {REPORT} SELECT * FROM report")
def rank_report(spark, folder):
    return report(spark, folder)


@query("report_totals", f"""
WITH {REPORT} SELECT (SELECT count(DISTINCT cve_id) FROM pairs) AS truth_queries, count(DISTINCT cve_id) AS matched_queries, count(*) AS pairs FROM report
""")
def report_totals(spark, folder):
    return evaluate.report_totals(report(spark, folder), report_truth(spark, folder))


_recalls = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}" for k in evaluate.CUTS)


@query("report_stats", f"WITH {REPORT} SELECT model, round(avg(1.0::DOUBLE / rank), 6) AS mrr, {_recalls} FROM ranks GROUP BY ALL")
def report_stats(spark, folder):
    out = evaluate.report_stats(report(spark, folder), MODELS)
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


@query("rank_matrix", f"""
WITH {RANKED} SELECT cve_id, capec_id, 'Pattern ' || split_part(capec_id, '-', 2) AS name,
  max(CASE WHEN model = 'vector' THEN rank END) AS vector_rank, max(CASE WHEN model = 'vector_keyword' THEN rank END) AS vector_keyword_rank
FROM ranked WHERE capec_id <> 'CAPEC-9' GROUP BY ALL
""")
def rank_matrix(spark, folder):
    return tasks.rank_matrix(ranked(spark, folder), patterns(spark, folder), MODELS)
