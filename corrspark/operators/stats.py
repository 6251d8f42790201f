"""Catalogue statistics. Every figure is an aggregate with a map-side part;
percentages are taken over the small aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrspark.functions import records as R
from corrspark.lexicon import SEVERITY_RANGES
from corrspark.operators.cpe import product_of, vendor_of


def _with_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """Add the share of each row in the total; the total is one number."""
    total = counts.agg(F.sum(n)).scalar()
    percent = F.when(total > 0, F.col(n) / total * 100).otherwise(0.0)
    return counts.withColumn("percent", percent)


def record_totals(cves: DataFrame) -> DataFrame:
    valid = R.is_valid_record(F.col("description"))
    return cves.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"))


def rating_distribution(cves: DataFrame, rating: Column | None = None) -> DataFrame:
    """(rating, n, percent) of valid rated records; all four buckets are listed."""
    if rating is None:
        rating = R.overall_severity(F.col("impact_v2"), F.col("impact_v3"))
        cves = cves.filter(R.is_rated(F.col("impact_v2"), F.col("impact_v3")))
    if "description" in cves.columns:
        cves = cves.filter(R.is_valid_record(F.col("description")))
    counts = cves.groupBy(rating.alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    names = [name for name, _, _ in SEVERITY_RANGES]
    buckets = cves.sparkSession.createDataFrame([(name,) for name in names], "rating string")
    filled = buckets.join(counts, "rating", "left")
    return _with_percent(filled.select("rating", F.coalesce("n", F.lit(0)).alias("n")))


def per_year(ids: DataFrame, year: Column, last_year: int | None = None) -> DataFrame:
    """(year, n, percent) of records up to the given or current year."""
    limit = F.year(F.current_date()) if last_year is None else F.lit(last_year)
    counts = ids.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return _with_percent(counts.filter(F.col("year") <= limit))


def linked_flags(records: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Records with ``linked``: is there at least one link row."""
    ends = links.select(key).distinct().withColumn("linked", F.lit(True))
    return records.join(ends, key, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def linked_share(records: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """One row: records, records with a link, percent."""
    flags = linked_flags(records, key, links)
    n, linked = F.count(F.lit(1)), F.count_if(F.col("linked"))
    return flags.agg(n.alias("n"), linked.alias("linked"), F.coalesce(linked / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias("percent"))


def linked_share_per_year(records: DataFrame, key: str, links: DataFrame, year: Column) -> DataFrame:
    flags = linked_flags(records, key, links)
    linked = F.count_if(F.col("linked"))
    counts = flags.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"), linked.alias("linked"))
    return counts.withColumn("percent", F.col("linked") / F.col("n") * 100)


def top_per_group(pairs: DataFrame, group: str, item: str, n: int = 10) -> DataFrame:
    """(group, item, n, place) of the n most frequent items per group, ties by item."""
    counts = pairs.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= n)


def top_linked(table: DataFrame, key: str, links: DataFrame, n: int = 20) -> DataFrame:
    """(key, n_links) of the most linked rows; rows without link count zero."""
    counts = links.groupBy(key).agg(F.count(F.lit(1)).alias("n_links"))
    rows = table.select(key).join(counts, key, "left").select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.orderBy(F.desc("n_links"), key).limit(n)


def top_values(values: DataFrame, col: str, n: int = 20) -> DataFrame:
    counts = values.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), col).limit(n)


def top_vendors_products(cves: DataFrame, uris: str = "vulnerable_cpe_uris", n: int = 20) -> DataFrame:
    """(kind, name, n) of the most frequent vendors and products.

    Both lists come from one scan: URIs are counted as (vendor, product) pairs
    first. URIs too short to name a product are skipped.
    """
    exploded = cves.select(F.explode(uris).alias("uri"))
    pairs = exploded.groupBy(vendor_of(F.col("uri")).alias("vendor"), product_of(F.col("uri")).alias("product")).agg(F.count(F.lit(1)).alias("c"))
    kinds = F.explode(F.array(
        F.struct(F.lit("vendor").alias("kind"), F.col("vendor").alias("name")),
        F.struct(F.lit("product").alias("kind"), F.col("product").alias("name")),
    ))
    named = pairs.filter(F.col("product").isNotNull()).select(kinds.alias("k"), "c")
    counts = named.groupBy("k.kind", "k.name").agg(F.sum("c").alias("n"))
    within = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return counts.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= n).select("kind", "name", "n")


def pattern_totals(patterns: DataFrame, steps: DataFrame) -> DataFrame:
    """One row of pattern counts.

    ``without_flow`` subtracts all flows, also of deprecated patterns, from the
    valid patterns, as published; ``valid_without_flow`` counts them properly.
    """
    dead = F.col("status").eqNullSafe(F.lit("Deprecated"))
    flow = F.coalesce(F.col("has_execution_flow"), F.lit(False))
    counts = patterns.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(dead).alias("deprecated"),
        F.count_if(~dead).alias("valid"),
        F.count_if(flow).alias("with_flow"),
        (F.count_if(~dead) - F.count_if(flow)).alias("without_flow"),
        F.count_if(~dead & ~flow).alias("valid_without_flow"),
    )
    return counts.withColumn("steps", steps.agg(F.count(F.lit(1))).scalar())


def steps_per_flow(flows: DataFrame, steps: DataFrame, key: str = "capec_id") -> DataFrame:
    """(key, n_steps) of every flow, flows without steps included."""
    counts = steps.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps"))
    return flows.select(key).join(counts, key, "left").select(key, F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def degree_histogram(degrees: DataFrame, col: str) -> DataFrame:
    """(degree, n, percent)."""
    return _with_percent(degrees.groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def mean_degree(degrees: DataFrame, col: str, out: str) -> DataFrame:
    return degrees.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias(out))


def value_distribution(rows: DataFrame, col: str) -> DataFrame:
    """(value, n, percent), e.g. of the phases of attack steps."""
    return _with_percent(rows.groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def link_degrees(table: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, degree) of every row, zero included."""
    counts = links.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))
    return table.select(key).join(counts, key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


def request_totals(requests: DataFrame) -> DataFrame:
    """One row: distinct ids, and the sum of the per-host counts."""
    pairs = requests.select("host", "cve_id").distinct()
    return pairs.agg(F.count_distinct("cve_id").alias("unique_ids"), F.count(F.lit(1)).alias("host_ids"))
