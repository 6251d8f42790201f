"""Catalogue refresh: feeds in, linked and versioned tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrspark.operators import clean, control, links, upsert
from corrspark.sources import catalogues, cve
from corrspark.sources.writers import write_snapshot


Tables = dict[str, DataFrame]


def _latest(rows: DataFrame, old: DataFrame | None) -> DataFrame:
    """Rows of a catalogue file by id, the last one of the file; rows of an older table that it lacks stay."""
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    if old is None:
        return upsert.last_per_key(placed, ["id"], ["_place"]).drop("_place")
    return upsert.upsert(old, placed, ["id"], ["_place"])


def cve_tables(
    spark: SparkSession, path: str, old: DataFrame | None = None, old_references: DataFrame | None = None, old_mentions: DataFrame | None = None
) -> Tables:
    """The tables of a folder of feed files, see :func:`feed_tables`."""
    return feed_tables(cve.read_feed(spark, path), old, old_references, old_mentions)


def feed_tables(feed: DataFrame, old: DataFrame | None = None, old_references: DataFrame | None = None, old_mentions: DataFrame | None = None) -> Tables:
    """Records, references, weakness mentions and quarantined rows of a feed.

    References of earlier feeds stay; the last mention of a url wins. Weakness
    mentions of records that the feed does not hold stay, too; a record that it
    holds has just those of the feed.
    """
    rows = cve.records(feed)
    good = cve.accepted(rows)
    order = ["file_year", "pos"]
    table = upsert.last_per_key(good, ["id"], order).drop(*order) if old is None else upsert.upsert(old, good, ["id"], order)
    refs = cve.references(feed).join(good.select(F.col("id").alias("cve_id")), "cve_id", "left_semi")
    ref_order = [*order, "ref_pos"]
    return {
        "cve": table,
        "cve_reference": upsert.last_per_key(refs, ["cve_id", "url"], ref_order).drop(*ref_order)
        if old_references is None else upsert.upsert(old_references, refs, ["cve_id", "url"], ref_order),
        "weakness_mentions": upsert.replace_children(old_mentions, cve.weakness_mentions(feed), good.select(F.col("id").alias("cve_id")), "cve_id"),
        "refreshed": good.select("id").distinct(),
        "quarantine": cve.quarantined(rows),
        "version": cve.feed_version(feed),
    }


def capec_tables(spark: SparkSession, path: str, old: Tables | None = None) -> Tables:
    """Patterns, steps, relations and text versions; ``old`` are the tables of the last refresh."""
    old = old or {}
    raw = catalogues.read_capec(spark, path)
    read = clean.aggregate_raw_patterns(catalogues.capec_records(raw))
    patterns = _latest(read, old.get("capec"))
    ids = read.select(F.col("id").alias("capec_id"), F.col("id").alias("source"))
    steps = upsert.replace_children(old.get("attack_step"), clean.aggregate_steps(links.number_steps(catalogues.capec_steps(raw))), ids, "capec_id")
    edges = links.related_patterns(catalogues.capec_relations(raw), patterns)
    return {
        "capec": patterns,
        "attack_step": steps,
        "capec_related_pattern": upsert.replace_children(old.get("capec_related_pattern"), edges, ids, "source"),
        "preprocessed_capec": clean.pattern_versions(patterns),
        "preprocessed_attack_step": clean.step_versions(steps),
        "version": catalogues.capec_header(spark, path),
    }


def cwe_tables(spark: SparkSession, path: str, old: Tables | None = None) -> Tables:
    """Weaknesses (with placeholders), relations and mentions; ``old`` are the tables of the last refresh."""
    old = old or {}
    raw = catalogues.read_cwe(spark, path)
    read = catalogues.cwe_records(raw)
    ids = read.select(F.col("id").alias("source"))
    edges = upsert.replace_children(old.get("cwe_related_weakness"), links.related_weaknesses(catalogues.cwe_relations(raw)), ids, "source")
    table = upsert.placeholders(_latest(read, old.get("cwe")), "id", edges, "target")
    return {
        "cwe": table,
        "cwe_related_weakness": edges,
        "pattern_mentions": upsert.replace_children(old.get("pattern_mentions"), catalogues.pattern_mentions(raw), read.select(F.col("id").alias("cwe_id")), "cwe_id"),
        "refreshed": read.select("id").distinct(),
        "version": catalogues.cwe_header(spark, path),
    }


def rebuild(entity: str, tables: Tables, root: str) -> dict[str, str]:
    """Drop an entity and build it again: every table of it is replaced, none is merged.

    ``tables`` are freshly read (without old tables). Table to the folder of its new
    version; nothing is switched before all tables have been found.
    """
    names = control.rebuild_targets(entity)
    missing = [n for n in names if n not in tables]
    if missing:
        raise ValueError(f"tables to rebuild are missing: {missing}")
    return {n: write_snapshot(tables[n], f"{root.rstrip('/')}/{n}") for n in names}


def _bridge(old: DataFrame | None, mentions: DataFrame, left: Tables, name: str, left_key: str, right: DataFrame, right_key: str, before: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    if old is None or before is None:
        return links.link(mentions, left[name], left_key, right, right_key)
    ids = left["refreshed"].select(F.col("id").alias(left_key))
    fresh = ids.join(mentions, left_key, "left")  # a refreshed record without mentions loses its links
    kept = mentions.join(ids, left_key, "left_anti")
    changed = lambda a, b: a.select("id").join(b.select("id"), "id", "left_anti")
    return links.refresh_links(
        old, kept, fresh, left[name], left_key, right, right_key, changed(left[name], before[0]), changed(right, before[1]),
        changed(before[0], left[name]), changed(before[1], right))


def link_tables(
    cves: Tables, cwes: Tables, capecs: Tables, old: Tables | None = None, before: Tables | None = None
) -> Tables:
    """The bridges between the three catalogues.

    With the bridges of the last refresh (``old``) and the tables ``cve``, ``cwe`` and
    ``capec`` of that time (``before``) only what changed is linked anew.
    """
    old, before = old or {}, before or {}
    then = lambda a, b: (before[a], before[b]) if a in before and b in before else None
    return {
        "cve_cwe": _bridge(old.get("cve_cwe"), cves["weakness_mentions"], cves, "cve", "cve_id", cwes["cwe"], "cwe_id", then("cve", "cwe")),
        "cwe_capec": _bridge(old.get("cwe_capec"), cwes["pattern_mentions"], cwes, "cwe", "cwe_id", capecs["capec"], "capec_id", then("cwe", "capec")),
    }
