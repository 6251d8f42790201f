"""The whole correlation as one plan, and what is read from its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrspark.operators import clean, keyword, links, similarity, tasks
from corrspark.plans.encode import Encode
from corrspark.session import materialise
from corrspark.sources.writers import write_errors, write_results


def pattern_texts(patterns: DataFrame, steps: DataFrame | None = None, fields=similarity.FIELDS, compat: bool = False) -> DataFrame:
    """(capec_id, kind, slot, text) of everything that is compared."""
    rows = similarity.field_texts(patterns, fields)
    return rows if steps is None else rows.unionByName(similarity.step_texts(steps, compat))


def pattern_keywords(patterns: DataFrame) -> DataFrame:
    """(capec_id, keyword): names and alternate terms."""
    terms = F.concat(F.array("name"), F.coalesce("alternate_terms", F.array().cast("array<string>")))
    return patterns.select(F.col("id").alias("capec_id"), F.explode(terms).alias("keyword")).filter(F.col("keyword") != "")


def prepare(
    requests: DataFrame,
    cves: DataFrame,
    patterns: DataFrame,
    options: clean.CleanOptions = clean.SERVICE_DEFAULTS,
    compat: bool = False,
    share: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(texts with their keyword hits, errors) of the requested ids: what all models read.

    With ``share`` both are written once, so that neither cleaning nor search runs
    again for a model, its errors or a failed model's successor.
    """
    cleaned = clean.clean_requested(requests, cves, options)
    if share:
        cleaned = materialise(cleaned, "cleaned")
    good = cleaned.filter(F.col("error").isNull()).select("cve_id", "text")
    hits = keyword.keyword_hits(good, pattern_keywords(links.active_patterns(patterns)), keep=("text",), compat=compat)
    if share:
        hits = materialise(hits, "hits")
    return hits, cleaned.filter(F.col("error").isNotNull()).select("cve_id", "error")


def correlate(
    requests: DataFrame,
    cves: DataFrame,
    patterns: DataFrame,
    encoders: dict[str, Encode],
    steps: DataFrame | None = None,
    options: clean.CleanOptions = clean.SERVICE_DEFAULTS,
    fields=similarity.FIELDS,
    top: int | None = None,
    flow_weight: int = 1,
    compat: bool = False,
    task_id: str = "task",
    scores: bool = False,
    prepared: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of a task.

    ``encoders`` maps a model name to an encoder (see plans.encode). Ids that can't
    be cleaned (model null) or that a model gives no vector are returned as errors
    with their model and do not stop the rest. Results are rows of task, id, model,
    pattern, score and rank, for each model and its keyword variant; ``scores`` adds
    the field and flow scores. ``prepared`` is what :func:`prepare` gave.
    """
    hits, uncleaned = prepared or prepare(requests, cves, patterns, options, compat, share=len(encoders) > 1)
    parts = pattern_texts(links.active_patterns(patterns), steps, fields, compat)
    results = errors = None
    for model, encode in encoders.items():
        catalogue = encode(parts)  # first: an encoder that fits itself fits on the patterns
        vectors = encode(hits)
        if prepared or len(encoders) > 1:  # read for the scores and for the errors
            vectors = materialise(vectors, "vectors")
        rows = similarity.score_patterns(vectors, catalogue, model=model, hits="hits", top=top, flow_weight=flow_weight, scores=scores)
        results = rows if results is None else results.unionByName(rows)
        missing = similarity.without_vector(vectors).withColumn("model", F.lit(model))
        errors = missing if errors is None else errors.unionByName(missing)
    uncleaned = uncleaned.select("cve_id", "error", F.lit(None).cast("string").alias("model"))
    errors = uncleaned if errors is None else uncleaned.unionByName(errors)
    return results.select(F.lit(task_id).alias("task_id"), "*"), errors.select(F.lit(task_id).alias("task_id"), "*")


def run_task(
    path: str,
    requests: DataFrame,
    cves: DataFrame,
    patterns: DataFrame,
    encoders: dict[str, Encode],
    task_id: str = "task",
    clean_options: clean.CleanOptions = clean.SERVICE_DEFAULTS,
    compat: bool = False,
    scores: bool = True,
    **options,
) -> dict[str, str]:
    """Correlate and store the results with all their scores, and the errors, one job per model.

    Texts are cleaned and searched for keywords once for all models, and encoded once
    per model. A model whose job fails is reported by name and does not stop the
    others. Errors are stored in the folder ``<path>_errors``; ids without a result
    have a row there. A repeated task replaces its rows in both, also by none.
    """
    failed = {}
    prepared = prepare(requests, cves, patterns, clean_options, compat)
    for model, encode in encoders.items():
        try:
            results, errors = correlate(requests, cves, patterns, {model: encode}, task_id=task_id, compat=compat, scores=scores, prepared=prepared, **options)
            write_results(results, path, [(task_id, model), (task_id, f"{model}_keyword")])
            write_errors(errors.withColumn("model", F.lit(model)), f"{path.rstrip('/')}_errors", [(task_id, model)])
        except Exception as error:  # whatever the encoder raised, the next model still runs
            failed[model] = str(error)
    return failed


def finished_models(results: DataFrame) -> DataFrame:
    """(task_id, model): the models of finished tasks, each one and its keyword variant, from the stored rows."""
    return results.select("task_id", "model").distinct()


def correlations(results: DataFrame) -> DataFrame:
    """(task_id, cve_id, status): one row per correlated id."""
    return results.select("task_id", "cve_id").distinct().withColumn("status", F.lit("complete"))


def finish(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(task_id, status) after a run."""
    state = tasks.completeness(requests, correlations(results))
    return state.select("task_id", tasks.task_status(F.col("is_complete")).alias("status"))
