"""Sinks: snapshot tables, result partitions, reports and statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

CURRENT = "_current"


def write_snapshot(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a table version to a new folder, then point the table at it.

    The folder being read is never overwritten; a job that dies half way leaves
    the old version in place.
    """
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    pointer = json.dumps({"path": path, "schema": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(pointer,)], "pointer string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{CURRENT}")
    return path


def read_snapshot(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame | None:
    """The current version of a table, or an empty one, or None without schema.

    The schema is read from the pointer, so no file footer is opened for it.
    """
    try:
        pointer = json.loads(spark.read.text(f"{root.rstrip('/')}/{CURRENT}").first()["value"])
    except AnalysisException:
        return None if schema is None else spark.createDataFrame([], schema)
    fields = StructType.fromJson(pointer["schema"])
    return spark.read.schema(fields).parquet(pointer["path"]).select(*fields.names)


def _replace_parts(rows: DataFrame, path: str, parts: list[tuple[str, str]]) -> None:
    """Write rows of tasks and models over what earlier runs left; named parts without new rows are emptied.

    New rows are in place before anything is removed, so a failed run changes nothing.
    """
    seen = Observation()
    counts = [F.count(F.when((F.col("task_id") == t) & (F.col("model") == m), 1)).alias(f"n{i}") for i, (t, m) in enumerate(parts)]
    observed = rows.observe(seen, F.count(F.lit(1)).alias("all"), *counts)
    observed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id", "model").parquet(path)
    spark = rows.sparkSession
    for i, (task, model) in enumerate(parts):
        if seen.get[f"n{i}"] == 0:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/task_id={task}/model={model}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_results(results: DataFrame, path: str, parts: list[tuple[str, str]] = ()) -> None:
    """Result rows, one partition folder per task and model; a repeated task replaces its own rows.

    Score arrays are written as they are, so a reader of ranks does not read them.
    Of ``parts`` (task and model) the old rows go even if the new run has none.
    """
    _replace_parts(results, path, list(parts))


def write_errors(errors: DataFrame, path: str, parts: list[tuple[str, str]] = ()) -> None:
    """Rows of task, model, id and reason, beside the results."""
    _replace_parts(errors, path, list(parts))


def similarity_document(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Results in their nested form: model to the ordered list of patterns.

    With score arrays every pattern has them by name, as ``scores``: each field's,
    the flow's where there is one. The list of one key and model is one catalogue long.
    """
    entry = [F.col("rank"), F.col("capec_id"), F.col("final_score")]
    if "field_scores" in ranked.columns:
        fields = F.arrays_zip(F.transform("fields", lambda f: F.concat(f, F.lit("_score"))).alias("name"), F.col("field_scores").alias("score"))
        flow = F.filter(F.array(F.struct(F.lit("execution_flow_score").alias("name"), F.col("execution_flow_score").alias("score"))), lambda s: s["score"].isNotNull())
        entry.append(F.map_from_entries(F.concat(fields, flow)).alias("scores"))
        # maps have no order of their own: the list is put in order by rank alone
        listed = F.array_sort(F.collect_list(F.struct(*entry)), lambda a, b: a["rank"] - b["rank"])
    else:
        listed = F.array_sort(F.collect_list(F.struct(*entry)))
    lists = ranked.groupBy(*keys, "model").agg(listed.alias("patterns"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", "patterns"))).alias("similarity_scores"))


def write_report(report: DataFrame, path: str, by: tuple[str, ...] = ("host", "model"), fmt: str = "csv") -> None:
    """A report with one folder per sheet."""
    writer = report.write.mode("overwrite").partitionBy(*by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_statistics(tables: dict[str, DataFrame], path: str) -> None:
    """Small result tables as JSON, each row stamped with the time of the run."""
    for name, table in tables.items():
        table.withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def is_fresh(stamp: Column, last_update: Column) -> Column:
    """Statistics are served while they are not older than the last refresh."""
    return F.coalesce(last_update <= stamp, F.lit(False))


def statistics(spark: SparkSession, path: str, name: str, control: DataFrame, entity: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored statistics while fresh, else built and stored again."""
    target = f"{path.rstrip('/')}/{name}"
    last = control.filter(F.col("name") == entity).agg(F.max("last_update")).scalar()
    try:
        stored = spark.read.json(target)
        stamp = stored.agg(F.max(F.to_timestamp("timestamp")).alias("stamp"))
        if stamp.select(is_fresh(F.col("stamp"), last).alias("ok")).first()["ok"]:
            return stored
    except AnalysisException:
        pass
    write_statistics({name: build()}, path)
    return spark.read.json(target)


def drop_task(path: str, results: DataFrame, doomed: DataFrame) -> None:
    """Rewrite the results without the listed tasks."""
    kept = results.join(doomed.select("task_id").distinct(), "task_id", "left_anti")
    write_snapshot(kept, path, ("task_id",))
