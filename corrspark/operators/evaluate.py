"""Rank quality against a ground truth.

Ranks are reduced to a histogram (model, rank, n) first; every metric is then a
sum over that small table, so all cut-offs cost one shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrspark.functions.records import cve_sort_key

# The cut-offs shown in reports.
CUTS = (1, 5, 10, 20)
METRICS = ("recall", "precision", "mrr", "f1", "ndcg")


def truth_ranks(ranked: DataFrame, truth: DataFrame, key: str = "cve_id") -> DataFrame:
    """(key, capec_id, model, rank) of the true pairs that were ranked."""
    return ranked.join(truth.select(key, "capec_id").distinct(), [key, "capec_id"]).select(key, "capec_id", "model", "rank")


def histogram(ranks: DataFrame) -> DataFrame:
    return ranks.filter(F.col("rank").isNotNull()).groupBy("model", "rank").agg(F.count(F.lit(1)).alias("n"))


def _share(hits: Column, total: Column) -> Column:
    """A ratio, null when nothing was found."""
    return hits / F.nullif(total, F.lit(0))


def metrics_at_k(ranks: DataFrame, k_max: int = 20, pairs: DataFrame | None = None) -> DataFrame:
    """(model, k, n, recall, precision, mrr, f1, ndcg) for k = 1..k_max.

    The denominator is the number of ranks found; ``pairs`` (model, pairs)
    supplies another one, so that a missed pair lowers the scores.
    """
    bars = histogram(ranks)
    k = F.explode(F.sequence(F.lit(1), F.lit(k_max)))
    models = bars.groupBy("model").agg(F.sum("n").alias("n"))
    if pairs is not None:
        models = models.drop("n").join(pairs.select("model", F.col("pairs").alias("n")), "model")
    inside = bars.filter(F.col("rank").between(1, k_max)).withColumn("k", F.explode(F.sequence(F.col("rank").cast("int"), F.lit(k_max))))
    sums = inside.groupBy("model", "k").agg(
        F.sum("n").alias("hits"),
        F.sum(F.col("n") / F.col("rank")).alias("rr"),
        F.sum(F.col("n") / F.log2(F.col("rank") + 1)).alias("gain"),
    )
    grid = models.withColumn("k", k).join(sums, ["model", "k"], "left")
    hits, n = F.coalesce("hits", F.lit(0)), F.col("n")
    recall = F.coalesce(_share(hits, n), F.lit(0.0))
    precision = F.round(F.coalesce(_share(hits, n * F.col("k")), F.lit(0.0)), 3)
    both = precision + recall
    return grid.select(
        "model",
        "k",
        "n",
        F.round(recall, 3).alias("recall"),
        precision.alias("precision"),
        F.round(F.coalesce(_share(F.coalesce("rr", F.lit(0.0)), n), F.lit(0.0)), 3).alias("mrr"),
        F.round(F.when(both > 0, 2 * precision * recall / both).otherwise(0.0), 3).alias("f1"),
        F.round(_share(F.coalesce("gain", F.lit(0.0)), n), 3).alias("ndcg"),
    )


def overall(ranks: DataFrame) -> DataFrame:
    """(model, n, mrr, mean_rank) over all found ranks."""
    bars = histogram(ranks)
    reciprocal = F.when(F.col("rank") > 0, F.col("n") / F.col("rank")).otherwise(0.0)
    sums = bars.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum(reciprocal).alias("rr"), F.sum(F.col("n") * F.col("rank")).alias("total")
    )
    return sums.select(
        "model", "n",
        F.round(F.col("rr") / F.col("n"), 3).alias("mrr"),
        F.round(F.col("total") / F.col("n"), 3).alias("mean_rank"),
    )


def chart_recall(ranks: DataFrame, k_max: int = 20, first_model: str | None = None) -> DataFrame:
    """Unrounded recall per k over the number of ranks of one model, as charted.

    The denominator is that of ``first_model`` (default: the first by name).
    """
    bars = histogram(ranks)
    sizes = bars.groupBy("model").agg(F.sum("n").alias("total"))
    chosen = sizes.filter(F.col("model") == first_model) if first_model else sizes
    total = chosen.agg(F.min_by("total", "model")).scalar()
    inside = bars.filter(F.col("rank") <= k_max).withColumn("k", F.explode(F.sequence(F.greatest(F.col("rank").cast("int"), F.lit(1)), F.lit(k_max))))
    hits = inside.groupBy("model", "k").agg(F.sum("n").alias("hits"))
    grid = sizes.select("model", F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
    rows = grid.join(hits, ["model", "k"], "left").withColumn("total", total)
    return rows.select("model", "k", F.coalesce(_share(F.coalesce("hits", F.lit(0)), F.col("total")), F.lit(0.0)).alias("recall"))


def recall_over_rows(ranks: DataFrame, k: int) -> DataFrame:
    """Unrounded recall at k; rows without rank count in the denominator."""
    hit = F.coalesce(((F.col("rank") != 0) & (F.col("rank") <= k)).cast("int"), F.lit(0))
    return ranks.groupBy("model").agg((F.sum(hit) / F.count(F.lit(1))).alias("recall"))


def set_precision(ranked: DataFrame, truth: DataFrame, k: int, key: str = "cve_id") -> DataFrame:
    """(key, model, precision): share of the first k predictions that are true."""
    first = ranked.filter(F.col("rank") <= k)
    marked = first.join(truth.select(key, "capec_id", F.lit(1).alias("_true")).distinct(), [key, "capec_id"], "left")
    return marked.groupBy(key, "model").agg((F.count("_true") / F.lit(k)).alias("precision"))


def mean_set_precision(ranked: DataFrame, truth: DataFrame, k: int, key: str = "cve_id") -> DataFrame:
    return set_precision(ranked, truth, k, key).groupBy("model").agg(F.avg("precision").alias("precision"))


def metric_cuts(ranks: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row per model and metric with a column per cut-off."""
    at_k = metrics_at_k(ranks, max(cuts))
    long_rows = at_k.unpivot(["model", "k"], list(METRICS), "metric", "value")
    wide = long_rows.groupBy("model", "metric").pivot("k", list(cuts)).agg(F.first("value"))
    return wide.select("model", "metric", *[F.col(str(k)).alias(f"at_{k}") for k in cuts])


def rank_report(ranked: DataFrame, truth: DataFrame, patterns: DataFrame, models: list[str], key: str = "cve_id") -> DataFrame:
    """(key, capec_id, capec_name, <model>_rank …) for each true pair of a ranked query.

    A pair that was not ranked keeps null ranks; an unknown pattern keeps a name.
    """
    known = truth.select(key, "capec_id").distinct().join(ranked.select(key).distinct(), key, "left_semi")
    hits = ranked.filter(F.col("model").isin(models)).join(known, [key, "capec_id"], "left_semi")
    per_model = [F.max(F.when(F.col("model") == m, F.col("rank"))).alias(f"{m}_rank") for m in models]
    wide = hits.groupBy(key, "capec_id").agg(*per_model)
    names = patterns.select(F.col("id").alias("capec_id"), F.col("name").alias("_name"))
    rows = known.join(wide, [key, "capec_id"], "left").join(names, "capec_id", "left")
    name = F.coalesce("_name", F.lit("Unknown CAPEC"))
    return rows.select(key, "capec_id", name.alias("capec_name"), *[f"{m}_rank" for m in models])


def ordered_report(report: DataFrame, key: str = "cve_id") -> DataFrame:
    return report.orderBy(*cve_sort_key(F.col(key)), key, "capec_id")


def report_totals(report: DataFrame, truth: DataFrame, key: str = "cve_id") -> DataFrame:
    """One row: queries in the truth, queries matched, pairs reported."""
    listed = truth.agg(F.count_distinct(key)).scalar()
    seen = report.agg(F.count_distinct(key).alias("matched_queries"), F.count(F.lit(1)).alias("pairs"))
    return seen.select(listed.alias("truth_queries"), "matched_queries", "pairs")


def report_stats(report: DataFrame, models: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(model, mrr, recall_at_k …) over the ranks present in a report, unrounded."""
    long_rows = report.unpivot(["capec_id"], [f"{m}_rank" for m in models], "model", "rank")
    bars = histogram(long_rows.withColumn("model", F.regexp_replace("model", "_rank$", "")))
    total = F.sum("n")
    recalls = [(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / total).alias(f"recall_at_{k}") for k in cuts]
    return bars.groupBy("model").agg((F.sum(F.col("n") / F.col("rank")) / total).alias("mrr"), *recalls)
