"""Correlation requests and their results: hosts, completeness, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrspark.functions.records import cve_sort_key, cve_year, is_active
from corrspark.session import dealt
from corrspark.sources.inputs import GENERIC_HOST


#: Parts that the hosts of one id are spread over.
HOST_PARTS = 16


def invert_hosts(requests: DataFrame) -> DataFrame:
    """(cve_id, host, n_hosts): the hosts of each id, as rows.

    Kept long: an id that most hosts share is never gathered into one value, and its
    rows meet their count in ``HOST_PARTS`` parts by a hash of the host.
    """
    part = F.pmod(F.xxhash64("host"), F.lit(HOST_PARTS)).cast("int")
    pairs = requests.select("cve_id", "host").distinct().withColumn("_part", part)
    sizes = pairs.groupBy("cve_id", "_part").agg(F.count(F.lit(1)).alias("n")).groupBy("cve_id").agg(F.sum("n").alias("n_hosts"))
    copies = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    return pairs.join(copies, ["cve_id", "_part"]).select("cve_id", "host", "n_hosts")


def hosts_of(requests: DataFrame, cve_id: str) -> DataFrame:
    return requests.filter(F.col("cve_id") == cve_id).select("host").distinct()


def truth_requests(truth: DataFrame, task_id: str) -> DataFrame:
    """Each distinct id of a ground truth, requested for the generic host."""
    ids = truth.select("cve_id").distinct()
    return ids.select(F.lit(task_id).alias("task_id"), "cve_id", F.lit(GENERIC_HOST).alias("host"))


def task_page(requests: DataFrame, cves: DataFrame, results: DataFrame) -> DataFrame:
    """(host, cve_id, description) of the results of a task, by host and year."""
    done = results.select("cve_id").distinct()
    rows = requests.select("host", "cve_id").distinct().join(done, "cve_id", "left_semi")
    texts = cves.select(F.col("id").alias("cve_id"), "description")
    return rows.join(texts, "cve_id").select("host", "cve_id", "description").orderBy("host", cve_year(F.col("cve_id")), *cve_sort_key(F.col("cve_id")))


def rank_matrix(ranked: DataFrame, patterns: DataFrame, models: list[str], cve_id: object | None = None, key: str = "cve_id") -> DataFrame:
    """Every active pattern with its rank under each model.

    With ``cve_id`` the matrix of one query (a literal filter), else of all.
    """
    rows = ranked.filter(F.col("model").isin(models))
    ranks = [F.max(F.when(F.col("model") == m, F.col("rank"))).alias(f"{m}_rank") for m in models]
    names = patterns.filter(is_active(F.col("status"))).select(F.col("id").alias("capec_id"), "name")
    if cve_id is not None:
        wide = rows.filter(F.col(key) == cve_id).groupBy("capec_id").agg(*ranks)
        return names.join(wide, "capec_id", "left")
    # one row per query and active pattern; the active patterns are one small catalogue
    listed = names.agg(F.array_sort(F.collect_list(F.struct("capec_id", "name")))).scalar()
    pairs = rows.select(key).distinct().withColumn("_p", F.explode(listed)).select(key, "_p.capec_id", "_p.name")
    wide = rows.groupBy(key, "capec_id").agg(*ranks)
    return pairs.join(wide, [key, "capec_id"], "left")


def completeness(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, requested, complete, foreign, is_complete).

    Complete: as many complete results as requested ids, none for another id.
    """
    asked = requests.select("task_id", "cve_id")
    done = results.filter(F.col("status") == "complete").select("task_id", "cve_id")
    marks = asked.select("task_id", "cve_id", F.lit(1).alias("asked"), F.lit(0).alias("done")).unionByName(
        done.select("task_id", "cve_id", F.lit(0).alias("asked"), F.lit(1).alias("done"))
    )
    per_id = dealt(marks, "task_id", "cve_id").groupBy("task_id", "cve_id").agg(F.max("asked").alias("asked"), F.sum("done").alias("done"))
    totals = per_id.groupBy("task_id").agg(
        F.sum("asked").alias("requested"),
        F.sum("done").alias("complete"),
        F.sum(F.when(F.col("asked") == 0, F.col("done")).otherwise(0)).alias("foreign"),
    )
    ok = (F.col("complete") == F.col("requested")) & (F.col("foreign") == 0)
    return totals.withColumn("is_complete", ok)


def task_status(is_complete: Column) -> Column:
    return F.when(is_complete, "complete").otherwise("in_progress")


def top_patterns(requests: DataFrame, ranked: DataFrame, k: int, models: list[str], key: str = "cve_id") -> DataFrame:
    """(host, model, key, Rank_1, Score_1 …): the first k patterns, wide.

    Models without results are dropped by the caller; none left is an error.
    """
    if not models:
        raise ValueError("no valid model selected for the task")
    first = ranked.filter(F.col("model").isin(models) & (F.col("rank") <= k))
    cells = []
    for i in range(1, k + 1):
        at = F.col("rank") == i
        cells += [F.max(F.when(at, F.col("capec_id"))).alias(f"Rank_{i}"), F.max(F.when(at, F.col("final_score"))).alias(f"Score_{i}")]
    wide = first.groupBy("model", key).agg(*cells)
    hosts = requests.select("host", key).distinct()
    return hosts.join(wide, key).select("host", "model", key, *[c for c in wide.columns if c not in ("model", key)])


# --- graph -----------------------------------------------------------------


def graph_selection(requests: DataFrame, limit: int | None = None) -> DataFrame:
    """(host, cve_id): each id under its first host only, up to ``limit`` per host."""
    owned = requests.groupBy("cve_id").agg(F.min("host").alias("host"))
    if limit is not None:
        within = Window.partitionBy("host").orderBy("cve_id")
        owned = owned.withColumn("_i", F.row_number().over(within)).filter(F.col("_i") <= limit)
    return owned.select("host", "cve_id")


def graph_edges(selection: DataFrame, ranked: DataFrame, patterns: DataFrame, model: str, rank_limit: int = 5) -> DataFrame:
    """(source, target, kind, rank): host to id, and id to its first patterns."""
    hosts = selection.select(
        F.col("host").alias("source"), F.col("cve_id").cast("string").alias("target"),
        F.lit("host").alias("kind"), F.lit(None).cast("int").alias("rank"),
    )
    top = ranked.filter((F.col("model") == model) & (F.col("rank") <= rank_limit))
    top = top.join(selection.select("cve_id"), "cve_id", "left_semi")
    top = top.join(patterns.select(F.col("id").alias("capec_id")), "capec_id", "left_semi")
    cves = top.select(
        F.col("cve_id").cast("string").alias("source"), F.col("capec_id").alias("target"),
        F.lit("cve").alias("kind"), F.col("rank").cast("int").alias("rank"),
    )
    return hosts.unionByName(cves)


def graph_nodes(selection: DataFrame, edges: DataFrame, cves: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, type, label): every host, id and linked pattern once."""
    missing = F.lit("No description available.")
    hosts = selection.select(F.col("host").alias("id"), F.lit("host").alias("type"), F.col("host").alias("label")).distinct()
    texts = cves.select(F.col("id").alias("cve_id"), "description")
    ids = selection.join(texts, "cve_id", "left").select(
        F.col("cve_id").cast("string").alias("id"), F.lit("cve").alias("type"), F.coalesce("description", missing).alias("label")
    )
    linked = edges.filter(F.col("kind") == "cve").select(F.col("target").alias("id")).distinct()
    named = linked.join(patterns.select("id", "name"), "id").select(
        "id", F.lit("capec").alias("type"), F.coalesce("name", F.lit("No name available")).alias("label")
    )
    return hosts.unionByName(ids).unionByName(named)


def step_nodes(steps: DataFrame, pos: str = "pos") -> DataFrame:
    """(id, parent, step, phase): the attack steps of patterns as graph nodes."""
    node = F.concat(F.col("capec_id"), F.lit("_step_"), (F.col(pos) + 1).cast("string"))
    return steps.select(node.alias("id"), F.col("capec_id").alias("parent"), "step", "phase")
