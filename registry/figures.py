"""Catalogue statistics over orders, line items, parts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrspark.functions import records as R
from corrspark.operators import stats
from registry.base import query, table

_score = "floor(o_totalprice / 5000) / 10"


def cves(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as records: an id per year, severity from the price, some rejected."""
    score = F.floor(F.col("o_totalprice") / 5000) / 10
    v2 = F.struct(F.struct(score.alias("baseScore")).alias("cvssV2"))
    v3 = F.struct(F.struct((score + 1).alias("baseScore")).alias("cvssV3"))
    note = F.when(F.startswith("o_orderpriority", F.lit("1")), "Rejected reason: old").otherwise(F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cve_id"),
        F.year("o_orderdate").alias("year"),
        note.alias("description"),
        F.when(F.col("o_orderstatus") != "P", v2).alias("impact_v2"),
        F.when(F.col("o_orderstatus") == "O", v3).alias("impact_v3"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Set of (cve_id, cwe_id): returned items link an order with a supplier."""
    rows = table(spark, folder, "lineitem").filter(F.col("l_returnflag") == "R")
    return rows.select(F.col("l_orderkey").alias("cve_id"), F.col("l_suppkey").alias("cwe_id")).distinct()


CVES = f"""
cves AS (
  SELECT o_orderkey AS cve_id, CAST(year(o_orderdate) AS INT) AS year, NOT starts_with(o_orderpriority, '1') AS valid,
         CASE WHEN o_orderstatus = 'O' THEN {_score} + 1 WHEN o_orderstatus <> 'P' THEN {_score} END AS score FROM orders),
links AS (SELECT DISTINCT l_orderkey AS cve_id, l_suppkey AS cwe_id FROM lineitem WHERE l_returnflag = 'R')"""
RATING = """CASE WHEN score BETWEEN 0.1 AND 3.9 THEN 'Low' WHEN score BETWEEN 4.0 AND 6.9 THEN 'Medium'
  WHEN score BETWEEN 7.0 AND 8.9 THEN 'High' WHEN score BETWEEN 9.0 AND 10.0 THEN 'Critical' END"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("record_totals", f"WITH {CVES} SELECT count(*) AS total, count(*) FILTER (valid) AS valid FROM cves")
def record_totals(spark, folder):
    return stats.record_totals(cves(spark, folder))


@query("severity_labels", f"WITH {CVES} SELECT cve_id, {RATING} AS rating FROM cves")
def severity_labels(spark, folder):
    return cves(spark, folder).select("cve_id", R.overall_severity(F.col("impact_v2"), F.col("impact_v3")).alias("rating"))


@query("rating_distribution", f"""
WITH {CVES}, r AS (SELECT {RATING} AS rating, count(*) AS n FROM cves WHERE valid AND score IS NOT NULL GROUP BY ALL),
b AS (SELECT t.rating, coalesce(r.n, 0) AS n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) t(rating) LEFT JOIN r USING (rating))
SELECT rating, n, round(n / sum(n) OVER () * 100, 6) AS percent FROM b
""")
def rating_distribution(spark, folder):
    return rounded(stats.rating_distribution(cves(spark, folder)), "percent")


@query("count_per_year", f"WITH {CVES} SELECT year, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM cves WHERE valid AND year <= 1999 GROUP BY year")
def count_per_year(spark, folder):
    valid = cves(spark, folder).filter(R.is_valid_record(F.col("description")))
    return rounded(stats.per_year(valid, F.col("year"), 1999), "percent")


_linked = f"""
WITH {CVES}, f AS (SELECT cve_id, year, cve_id IN (SELECT cve_id FROM links) AS linked FROM cves WHERE valid)
SELECT %s count(*) AS n, count(*) FILTER (linked) AS linked, round(count(*) FILTER (linked) / count(*) * 100, 6) AS percent FROM f GROUP BY ALL"""


@query("linked_share", _linked % "")
def linked_share(spark, folder):
    valid = cves(spark, folder).filter(R.is_valid_record(F.col("description")))
    return rounded(stats.linked_share(valid, "cve_id", links(spark, folder)), "percent")


@query("linked_share_per_year", _linked % "year,")
def linked_share_per_year(spark, folder):
    valid = cves(spark, folder).filter(R.is_valid_record(F.col("description")))
    return rounded(stats.linked_share_per_year(valid, "cve_id", links(spark, folder), F.col("year")), "percent")


@query("top_links_per_year", f"""
WITH {CVES}, c AS (SELECT year, cwe_id, count(*) AS n FROM links JOIN cves USING (cve_id) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, cwe_id) AS place FROM c QUALIFY place <= 10
""")
def top_links_per_year(spark, folder):
    pairs = links(spark, folder).join(cves(spark, folder).select("cve_id", "year"), "cve_id")
    return stats.top_per_group(pairs, "year", "cwe_id", 10)


@query("top_links_all_time", f"""
WITH {CVES} SELECT s_suppkey AS cwe_id, count(l.cwe_id) AS n_links FROM supplier LEFT JOIN links l ON l.cwe_id = s_suppkey GROUP BY ALL
ORDER BY n_links DESC, s_suppkey LIMIT 20
""")
def top_links_all_time(spark, folder):
    weaknesses = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("cwe_id"))
    return stats.top_linked(weaknesses, "cwe_id", links(spark, folder), 20)


@query("top_patterns_by_links", f"""
WITH {CVES} SELECT c_custkey AS cve_id, count(l.cve_id) AS n_links FROM customer LEFT JOIN links l ON l.cve_id = c_custkey GROUP BY ALL
ORDER BY n_links DESC, c_custkey LIMIT 20
""")
def top_patterns_by_links(spark, folder):
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("cve_id"))
    return stats.top_linked(ids, "cve_id", links(spark, folder), 20)


_uris = "CASE WHEN l_linestatus = 'F' THEN 'cpe:2.3:a:' || p_brand || ':' || replace(p_name, ' ', '_') || ':1' ELSE 'cpe:2.3' END"


@query("top_vendors_products", f"""
WITH u AS (SELECT {_uris} AS uri FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT string_split(uri, ':') AS p FROM u),
k AS (SELECT unnest(['vendor', 'product']) AS kind, unnest([p[4], p[5]]) AS name FROM p WHERE len(p) >= 5),
c AS (SELECT kind, name, count(*) AS n FROM k GROUP BY ALL)
SELECT kind, name, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) <= 20
""")
def top_vendors_products(spark, folder):
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.top_vendors_products(rows.select(F.array(F.expr(_uris)).alias("uris")), "uris", 20)


def flows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as patterns, conversations with the same key as their flows."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("capec_id"), "turn", F.col("role").alias("phase"))
    known = turns.select(F.col("capec_id").alias("doc_id")).distinct().withColumn("has_execution_flow", F.lit(True))
    status = F.when(F.col("toxic") == 1, "Deprecated").when(F.col("toxic") == 0, "Draft")
    return rows.join(known, "doc_id", "left").select("doc_id", status.alias("status"), "has_execution_flow"), turns


@query("pattern_totals", """
WITH p AS (SELECT doc_id, toxic IS NOT DISTINCT FROM 1 AS dead, doc_id IN (SELECT conv_id FROM conversations) AS flow FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (dead) AS deprecated, count(*) FILTER (NOT dead) AS valid, count(*) FILTER (flow) AS with_flow,
       count(*) FILTER (NOT dead) - count(*) FILTER (flow) AS without_flow, count(*) FILTER (NOT dead AND NOT flow) AS valid_without_flow,
       (SELECT count(*) FROM conversations) AS steps FROM p
""")
def pattern_totals(spark, folder):
    patterns, steps = flows(spark, folder)
    return stats.pattern_totals(patterns, steps)


_steps = "WITH d AS (SELECT doc_id AS capec_id, count(conv_id) AS n_steps FROM documents LEFT JOIN conversations ON conv_id = doc_id GROUP BY doc_id)"


def _degrees(spark, folder):
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("capec_id"))
    return stats.steps_per_flow(ids, flows(spark, folder)[1])


@query("steps_histogram", _steps + " SELECT n_steps, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM d GROUP BY n_steps")
def steps_histogram(spark, folder):
    return rounded(stats.degree_histogram(_degrees(spark, folder), "n_steps"), "percent")


@query("mean_steps", _steps + " SELECT round(avg(n_steps), 6) AS mean_steps FROM d")
def mean_steps(spark, folder):
    return rounded(stats.mean_degree(_degrees(spark, folder), "n_steps", "mean_steps"), "mean_steps")


@query("phase_distribution", "SELECT role AS phase, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM conversations GROUP BY role")
def phase_distribution(spark, folder):
    return rounded(stats.value_distribution(flows(spark, folder)[1], "phase"), "percent")


@query("link_degree", f"""
WITH {CVES}, d AS (SELECT o_orderkey, count(l.cve_id) AS degree FROM orders LEFT JOIN links l ON l.cve_id = o_orderkey GROUP BY o_orderkey)
SELECT degree, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM d GROUP BY degree
""")
def link_degree(spark, folder):
    degrees = stats.link_degrees(cves(spark, folder), "cve_id", links(spark, folder))
    return rounded(stats.degree_histogram(degrees, "degree"), "percent")


@query("mean_links", f"WITH {CVES} SELECT round((SELECT count(*) FROM links JOIN cves USING (cve_id)) / (SELECT count(*) FROM cves), 6) AS mean_links")
def mean_links(spark, folder):
    degrees = stats.link_degrees(cves(spark, folder), "cve_id", links(spark, folder))
    return rounded(stats.mean_degree(degrees, "degree", "mean_links"), "mean_links")


@query("request_totals", "SELECT count(DISTINCT l_partkey) AS unique_ids, count(DISTINCT (l_suppkey, l_partkey)) AS host_ids FROM lineitem")
def request_totals(spark, folder):
    return stats.request_totals(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("host"), F.col("l_partkey").alias("cve_id")))
