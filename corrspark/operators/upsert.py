"""Upserts, placeholder rows and deletes on plain Parquet tables.

The last row per key is picked with ``max_by``, an aggregate with a map-side
part: a key that holds a third of all rows is reduced where it lies and only one
row per task and key is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest order columns."""
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.max_by(payload, rank).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones with the same key; the last new row wins.

    ``order`` names columns of ``new`` and is not part of the result. Columns that
    only one side has stay: a new row has nothing in those of the old table.
    """
    old_only = [f for f in old.schema.fields if f.name not in new.columns]
    new = new.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in old_only])
    columns = [c for c in new.columns if c not in order]
    old = old.select("*", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in columns if c not in old.columns])
    rank = F.struct(*[F.col(c) for c in order]).alias("_rank")
    fresh = new.select(*columns, F.lit(1).alias("_new"), rank)
    kept = old.select(*columns, F.lit(0).alias("_new"), F.lit(None).cast(fresh.schema["_rank"].dataType).alias("_rank"))
    return last_per_key(kept.unionByName(fresh), keys, ["_new", "_rank"]).select(*columns)


def replace_children(old: DataFrame | None, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows (steps, edges, references) after a refresh of their parents.

    A refreshed parent has just its new children; the others keep theirs.
    """
    if old is None:
        return new
    kept = old.join(parents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def placeholders(table: DataFrame, key: str, mentions: DataFrame, mention: str) -> DataFrame:
    """The table plus an otherwise empty row for each mentioned but missing key."""
    missing = mentions.select(F.col(mention).alias(key)).distinct().join(table, key, "left_anti")
    return table.unionByName(missing, allowMissingColumns=True)


def delete_keys(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; apply to each dependent table to cascade."""
    return table.join(doomed.select(key).distinct(), key, "left_anti")


def typed_edges(mentions: DataFrame, order: list[str], condition: Column | None = None) -> DataFrame:
    """One edge per (source, target); the nature listed last wins."""
    rows = mentions if condition is None else mentions.filter(condition)
    rows = rows.select("source", "target", "nature", *[c for c in order])
    return last_per_key(rows, ["source", "target"], order).select("source", "target", "nature")
