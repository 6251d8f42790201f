"""The refresh control table: versions, schedules and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEPENDANTS = {
    "CVE": ("cve", "cve_reference"),
    "CWE": ("cwe", "cwe_related_weakness"),
    "CAPEC": ("capec", "attack_step", "capec_related_pattern", "preprocessed_capec", "preprocessed_attack_step"),
}


def next_update(last_update: Column, frequency_days: Column) -> Column:
    """Date of the next refresh; null without a last update or a frequency."""
    usable = last_update.isNotNull() & (frequency_days > 0)
    return F.when(usable, last_update + F.make_dt_interval(frequency_days))


def record_refresh(control: DataFrame, done: DataFrame) -> DataFrame:
    """Mark refreshed entities. ``done``: (name, version, last_update).

    A null version keeps the old one; an entity without a row gets one.
    """
    fresh = done.select("name", F.col("version").alias("_version"), F.col("last_update").alias("_last"), F.lit(True).alias("_done"))
    joined = control.join(fresh, "name", "full_outer")
    hit = F.coalesce(F.col("_done"), F.lit(False))
    last = F.when(hit, F.col("_last")).otherwise(F.col("last_update"))
    due = F.coalesce(next_update(last, F.col("update_frequency")), F.col("next_scheduled_update"))
    return joined.select(
        "name",
        last.alias("last_update"),
        F.when(hit, due).otherwise(F.col("next_scheduled_update")).alias("next_scheduled_update"),
        (hit | F.coalesce(F.col("has_been_updated"), F.lit(False))).alias("has_been_updated"),
        "update_frequency",
        F.when(hit, F.coalesce("_version", "version")).otherwise(F.col("version")).alias("version"),
        F.coalesce("status", F.lit("Pending")).alias("status"),
    )


def set_status(control: DataFrame, status: str, name: str | None = None, only: str | None = None) -> DataFrame:
    """Set the status of all rows, of one row, or of the rows in one status."""
    hit = F.lit(True)
    if name is not None:
        hit = hit & (F.col("name") == name)
    if only is not None:
        hit = hit & (F.col("status") == only)
    return control.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def on_publish(control: DataFrame) -> DataFrame:
    return set_status(control, "In Progress", only="Pending")


def on_failure(control: DataFrame) -> DataFrame:
    return set_status(control, "Pending", only="In Progress")


def refresh_state(control: DataFrame) -> DataFrame:
    """One row: does anything need a refresh, does everything, is all in progress."""
    stale = ~F.coalesce(F.col("has_been_updated"), F.lit(False))
    return control.agg(
        (F.coalesce(F.bool_or(stale), F.lit(True))).alias("needs_update"),
        F.coalesce(F.bool_and(stale), F.lit(True)).alias("all_require_update"),
        F.coalesce(F.bool_and(F.col("status") == "In Progress"), F.lit(True)).alias("all_in_progress"),
    )


def rebuild_targets(entity: str) -> tuple[str, ...]:
    """Tables overwritten when one entity is rebuilt from scratch."""
    if entity not in DEPENDANTS:
        raise ValueError(f"unknown entity type: {entity}")
    return DEPENDANTS[entity]
