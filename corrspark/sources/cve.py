"""Vulnerability feed: yearly JSON files to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark import schemas

# Problem types that name no weakness.
UNLINKED = ("NVD-CWE-Other", "NVD-CWE-noinfo")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All feed files of a folder; ``file_year`` orders them."""
    raw = (
        spark.read.schema(schemas.CVE_FEED)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("file_name"))
    )
    year = F.regexp_extract("file_name", r"(?:^|-)(\d+)\.[^-]*$", 1).try_cast("int")
    return raw.withColumn("file_year", year)


def feed_version(feed: DataFrame) -> DataFrame:
    """Newest feed timestamp, as the date kept as the version of the data."""
    newest = F.max(parse_time(F.col("CVE_data_timestamp")))
    return feed.agg(F.date_format(newest, "yyyy-MM-dd").alias("version"))


def parse_time(col: Column) -> Column:
    """ISO text to timestamp; text that is missing or does not parse is null."""
    return F.coalesce(F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(col))


def english(descriptions: Column) -> Column:
    """Value of the first English entry, or null."""
    return F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"]


def cpe_uris(nodes: Column, vulnerable: bool) -> Column:
    """CPE URIs of the top-level nodes, split by the vulnerable flag."""
    nothing = F.array().cast("array<struct<vulnerable: boolean, cpe23Uri: string>>")
    matches = F.flatten(F.transform(nodes, lambda n: F.coalesce(n["cpe_match"], nothing)))
    flag = lambda m: F.coalesce(m["vulnerable"], F.lit(False))
    chosen = F.filter(matches, (lambda m: flag(m)) if vulnerable else (lambda m: ~flag(m)))
    return F.coalesce(F.transform(chosen, lambda m: m["cpe23Uri"]), F.array().cast("array<string>"))


def items(feed: DataFrame) -> DataFrame:
    """One row per feed item, with its file header and position."""
    order = [c for c in ("file_year",) if c in feed.columns]
    return feed.select(
        *order,
        F.col("CVE_data_type").alias("data_type"),
        F.col("CVE_data_format").alias("data_format"),
        F.col("CVE_data_version").alias("data_version"),
        F.posexplode("CVE_Items").alias("pos", "item"),
    )


def records(feed: DataFrame) -> DataFrame:
    """Typed vulnerability rows (not yet deduplicated)."""
    order = [c for c in ("file_year",) if c in feed.columns]
    return items(feed).select(
        *order,
        "pos",
        F.col("item.cve.CVE_data_meta.ID").alias("id"),
        F.col("item.cve.CVE_data_meta.ASSIGNER").alias("assigner"),
        "data_type", "data_format", "data_version",
        english(F.col("item.cve.description.description_data")).alias("description"),
        parse_time(F.col("item.publishedDate")).alias("published_date"),
        parse_time(F.col("item.lastModifiedDate")).alias("last_modified_date"),
        F.col("item.impact.baseMetricV2").alias("impact_v2"),
        F.col("item.impact.baseMetricV3").alias("impact_v3"),
        cpe_uris(F.col("item.configurations.nodes"), True).alias("vulnerable_cpe_uris"),
        cpe_uris(F.col("item.configurations.nodes"), False).alias("related_cpe_uris"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    """Rows that satisfy the NOT NULL columns; only the failing row is set aside."""
    return rows.filter(_complete())


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter(~_complete())


def _complete() -> Column:
    needed = ("id", "description", "published_date", "last_modified_date")
    ok = F.lit(True)
    for name in needed:
        ok = ok & F.col(name).isNotNull()
    return ok


def references(feed: DataFrame) -> DataFrame:
    """One row per reference of an item."""
    order = [c for c in ("file_year",) if c in feed.columns]
    rows = items(feed).select(
        *order,
        "pos",
        F.col("item.cve.CVE_data_meta.ID").alias("cve_id"),
        F.posexplode("item.cve.references.reference_data").alias("ref_pos", "ref"),
    )
    tags = F.coalesce(F.col("ref.tags"), F.array().cast("array<string>"))
    return rows.select(*order, "pos", "ref_pos", "cve_id", "ref.url", "ref.name", "ref.refsource", tags.alias("tags"))


def weakness_mentions(feed: DataFrame) -> DataFrame:
    """(cve_id, cwe_id) named by English problem types, placeholders left out."""
    return (
        items(feed)
        .select(
            F.col("item.cve.CVE_data_meta.ID").alias("cve_id"),
            F.explode("item.cve.problemtype.problemtype_data").alias("entry"),
        )
        .select("cve_id", F.explode("entry.description").alias("d"))
        .filter((F.col("d.lang") == "en") & ~F.col("d.value").isin(*UNLINKED))
        .select("cve_id", F.col("d.value").alias("cwe_id"))
    )
