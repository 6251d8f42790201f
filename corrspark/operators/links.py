"""Lookups, searches and link building between catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrspark.functions.records import facet_match, is_active, summary
from corrspark.operators.upsert import typed_edges


def existing(ids: DataFrame, table: DataFrame, key: str, table_key: str = "id") -> DataFrame:
    """Rows of ``ids`` whose key exists in the table."""
    return ids.join(table.select(F.col(table_key).alias(key)), key, "left_semi")


def by_ids(table: DataFrame, ids: DataFrame, key: str = "id", id_col: str = "cve_id") -> DataFrame:
    """Rows of the table named by an id frame."""
    return table.join(ids.select(F.col(id_col).alias(key)), key, "left_semi")


def active_patterns(patterns: DataFrame, version: str | None = None) -> DataFrame:
    """Patterns that are not deprecated, of one text version when given."""
    if version is not None:
        patterns = patterns.filter(F.col("preprocessed_version") == version)
    return patterns.filter(is_active(F.col("status")))


def link(mentions: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Set of mentioned pairs whose two ends both exist."""
    pairs = mentions.select(left_key, right_key).distinct()
    pairs = pairs.join(left.select(F.col("id").alias(left_key)), left_key, "left_semi")
    return pairs.join(right.select(F.col("id").alias(right_key)), right_key, "left_semi").select(left_key, right_key)


def refresh_links(
    old: DataFrame,
    kept_mentions: DataFrame,
    new_mentions: DataFrame,
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    left_added: DataFrame,
    right_added: DataFrame,
    left_removed: DataFrame | None = None,
    right_removed: DataFrame | None = None,
) -> DataFrame:
    """The links after a refresh, from those before it and what changed.

    ``new_mentions`` are those of refreshed records and replace theirs;
    ``kept_mentions`` those of all others. Both ends of a new mention are looked up.
    A kept one has a link already unless an end was missing, so it is looked at again
    only where an end was added (``left_added``, ``right_added``: ids that the table
    did not have). Links of refreshed and of removed ids go. So work grows with what
    changed; the large tables are only filtered by small ones.
    """
    pair = [left_key, right_key]
    named = lambda ids, key: ids.select(F.col("id").alias(key)).distinct()
    refreshed = new_mentions.select(left_key).distinct()
    stay = old.join(kept_mentions.select(*pair), pair, "left_semi").join(refreshed, left_key, "left_anti")
    if left_removed is not None:
        stay = stay.join(named(left_removed, left_key), left_key, "left_anti")
    if right_removed is not None:
        stay = stay.join(named(right_removed, right_key), right_key, "left_anti")
    again = kept_mentions.select(*pair).join(named(left_added, left_key), left_key, "left_semi").unionByName(
        kept_mentions.select(*pair).join(named(right_added, right_key), right_key, "left_semi"))
    fresh = link(new_mentions.filter(F.col(right_key).isNotNull()).select(*pair).unionByName(again), left, left_key, right, right_key)
    return stay.select(*pair).unionByName(fresh).distinct()


def related_weaknesses(mentions: DataFrame, view: str = "1000") -> DataFrame:
    """Weakness edges of one view; see placeholders for targets that are missing."""
    return typed_edges(mentions, ["pos"], F.col("view_id") == view)


def related_patterns(mentions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern edges whose two ends both exist."""
    ids = patterns.select("id")
    ends = mentions.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    ends = ends.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return typed_edges(ends, ["pos"])


def search(table: DataFrame, key: str, query: str) -> DataFrame:
    """The exact match, or else every row whose key starts with the query.

    The prefix filter, pushed to the source, covers both cases; whether an exact
    match exists is a scalar subquery, so no count reaches the driver.
    """
    found = table.filter(F.startswith(F.col(key), F.lit(query)))
    exact = found.agg(F.coalesce(F.bool_or(F.col(key) == query), F.lit(False))).scalar()
    return found.filter((F.col(key) == query) | ~exact)


def suggestions(table: DataFrame, key: str, query: str, detail: Column | None = None, limit: int = 10) -> DataFrame:
    """First ids that contain the query, whatever its case."""
    detail = summary(F.col("description")) if detail is None else detail
    hits = table.filter(F.contains(F.upper(F.col(key)), F.lit(query.upper())))
    return hits.select(F.col(key).alias("id"), detail.alias("detail")).orderBy("id").limit(limit)


def browse(
    table: DataFrame,
    query: str | None = None,
    search_in: tuple[str, ...] = ("id",),
    facets: dict[str, object] | None = None,
    order: list[Column] | None = None,
) -> DataFrame:
    """Multi-column search, facet filters and ordering of a list page."""
    rows = table
    if query:
        rows = rows.filter(facet_match([F.col(c) for c in search_in], query))
    for name, value in (facets or {}).items():
        rows = rows.filter(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order) if order else rows


def facet_counts(table: DataFrame, facet: str) -> DataFrame:
    return table.groupBy(facet).agg(F.count(F.lit(1)).alias("n"))


def detail(table: DataFrame, key_value: str, links: DataFrame, own: str, other: str, others: DataFrame) -> DataFrame:
    """One entity with its linked rows: (id, linked_id, linked_name).

    The entity id is a literal filter, pushed to every scan.
    """
    entity = table.filter(F.col("id") == key_value).select(F.col("id").alias(own))
    linked = links.filter(F.col(own) == key_value).select(own, F.col(other).alias("linked_id"))
    names = others.select(F.col("id").alias("linked_id"), F.col("name").alias("linked_name"))
    return entity.join(linked, own, "left").join(names, "linked_id", "left").select(F.col(own).alias("id"), "linked_id", "linked_name")


def number_steps(steps: DataFrame, key: str = "capec_id", step: str = "step", pos: str = "pos", chunk: int = 1 << 16) -> DataFrame:
    """Make step labels unique: the 2nd, 3rd … of a label gets suffix b, c ….

    Occurrences are numbered inside chunks of positions and offset by the counts
    of the chunks before, so a key of any size is never sorted in one task.
    """
    chunked = steps.withColumn(step, F.coalesce(step, F.lit(""))).withColumn("_chunk", F.floor(F.col(pos) / chunk))
    within = Window.partitionBy(key, step, "_chunk").orderBy(pos)
    before = Window.partitionBy(key, step).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy(key, step, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(key, step, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # steps without a position form a chunk of their own, patterns without an id a pattern
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (key, step, "_chunk")]
    numbered = chunked.withColumn("_i", F.row_number().over(within)).alias("s").join(offsets.alias("o"), same).select("s.*", "o._before")
    nth = F.col("_i") + F.col("_before")
    suffix = F.when(nth > 1, F.chr(F.lit(96) + nth)).otherwise("")
    return numbered.withColumn(step, F.concat(F.col(step), suffix)).select(*steps.columns)
