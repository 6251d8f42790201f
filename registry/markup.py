"""XML catalogues: built from the given tables, written, and read by the catalogue readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark.operators import clean, links, upsert
from corrspark.plans import refresh
from corrspark.session import scratch_dir
from corrspark.sources import catalogues
from corrspark.sources.writers import read_snapshot, write_snapshot
from registry.base import query, table


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _tag(name: str, content: Column, attributes: Column | None = None) -> Column:
    head = F.lit(f"<{name}>") if attributes is None else F.concat(F.lit(f"<{name} "), attributes, F.lit(">"))
    return F.concat(head, content, F.lit(f"</{name}>"))


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), _escaped(value.cast("string")), F.lit('" '))


def _written(rows: DataFrame, root: str, key: Column, xml: Column, name: str) -> str:
    """Elements in files of some hundreds, each with a root of its own."""
    files = -(-rows.count() // 500)
    head, end = F.lit(f'<{root} xmlns:xhtml="http://www.w3.org/1999/xhtml">'), F.lit(f"</{root}>")
    part = F.pmod(F.xxhash64(key), F.lit(max(1, files)))
    whole = rows.groupBy(part.alias("part")).agg(F.concat(head, F.array_join(F.collect_list(xml), ""), end).alias("xml"))
    path = scratch_dir(rows.sparkSession, name)
    whole.write.partitionBy("part").text(path)
    return path


def pattern_file(spark: SparkSession, folder: str) -> str:
    """Conversations as attack patterns: turns are steps, roles phases; two turns share a step number."""
    turns = table(spark, folder, "conversations")
    body = F.concat(_tag("Step", F.floor(F.col("turn") / 2).cast("string")), _tag("Phase", _escaped(F.col("role"))), _tag("Description", _escaped(F.col("text"))))
    steps = turns.select("conv_id", "turn", "text", _tag("Attack_Step", body).alias("step"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "step")))
    patterns = steps.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda s: s["step"]), "").alias("flow"), F.min_by("text", "turn").alias("text"))
    status = F.when(F.col("conv_id") % 5 == 0, "Deprecated").otherwise("Draft")
    attributes = F.concat(_attribute("ID", F.col("conv_id")), _attribute("Name", F.concat(F.lit("Talk & "), "conv_id")), _attribute("Abstraction", F.lit("Standard")), _attribute("Status", status))
    related = F.concat(F.lit('<Related_Attack_Pattern '), _attribute("CAPEC_ID", F.col("conv_id") + 1), _attribute("Nature", F.lit("CanPrecede")), F.lit("/>"))
    parts = F.concat(_tag("Description", F.concat(F.lit("<xhtml:p>"), _escaped(F.col("text")), F.lit("</xhtml:p>"))), _tag("Execution_Flow", F.col("flow")), _tag("Related_Attack_Patterns", related))
    return _written(patterns, "Attack_Pattern_Catalog", F.col("conv_id"), _tag("Attack_Pattern", parts, attributes), "patterns")


def weakness_file(spark: SparkSession, folder: str) -> str:
    """Customers as weaknesses: the nation is a parent, in one of two views, and names a pattern."""
    rows = table(spark, folder, "customer")
    view = F.when(F.col("c_custkey") % 2 == 0, "1000").otherwise("699")
    edge = F.concat(F.lit("<Related_Weakness "), _attribute("Nature", F.lit("ChildOf")), _attribute("CWE_ID", -F.col("c_nationkey")), _attribute("View_ID", view), F.lit("/>"))
    pattern = F.concat(F.lit("<Related_Attack_Pattern "), _attribute("CAPEC_ID", F.col("c_nationkey") * 10), F.lit("/>"))
    platform = F.concat(F.lit("<Language "), _attribute("Class", F.col("c_mktsegment")), _attribute("Prevalence", F.lit("Often")), F.lit("/>"))
    attributes = F.concat(_attribute("ID", F.col("c_custkey")), _attribute("Name", F.col("c_name")), _attribute("Status", F.lit("Stable")))
    parts = F.concat(
        _tag("Description", F.concat(F.lit("  a\n"), "c_name")), _tag("Related_Weaknesses", edge),
        _tag("Applicable_Platforms", platform), _tag("Related_Attack_Patterns", pattern))
    return _written(rows, "Weakness_Catalog", F.col("c_custkey"), _tag("Weakness", parts, attributes), "weaknesses")


_COLLAPSED = r"nullif(trim(regexp_replace({}, '\s+', ' ', 'g')), '')"
_PATTERNS = f"""
p AS (SELECT 'CAPEC-' || conv_id AS id, conv_id, 'Talk & ' || conv_id AS name, CASE WHEN conv_id % 5 = 0 THEN 'Deprecated' ELSE 'Draft' END AS status,
             {_COLLAPSED.format("arg_min(text, turn)")} AS description FROM conversations GROUP BY conv_id),
s AS (SELECT 'CAPEC-' || conv_id AS capec_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn // 2 AS step, role AS phase,
             {_COLLAPSED.format("text")} AS description FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY capec_id, step ORDER BY pos) AS nth FROM s)"""


@query("capec_xml_records", f"WITH {_PATTERNS} SELECT id, name, status, description FROM p")
def capec_xml_records(spark, folder):
    raw = catalogues.read_capec(spark, pattern_file(spark, folder))
    return catalogues.capec_records(raw).select("id", "name", "status", "description")


@query("capec_xml_steps", f"WITH {_PATTERNS} SELECT capec_id, pos, step || CASE WHEN nth > 1 THEN chr(CAST(96 + nth AS INTEGER)) ELSE '' END AS step, phase, description FROM t")
def capec_xml_steps(spark, folder):
    raw = catalogues.read_capec(spark, pattern_file(spark, folder))
    return links.number_steps(catalogues.capec_steps(raw)).select("capec_id", "pos", "step", "phase", "description")


@query("capec_xml_edges", f"""
WITH {_PATTERNS} SELECT id AS source, 'CAPEC-' || (conv_id + 1) AS target, 'CanPrecede' AS nature FROM p WHERE conv_id + 1 IN (SELECT conv_id FROM conversations)
""")
def capec_xml_edges(spark, folder):
    raw = catalogues.read_capec(spark, pattern_file(spark, folder))
    return links.related_patterns(catalogues.capec_relations(raw), catalogues.capec_records(raw))


@query("capec_xml_versions", f"""
WITH {_PATTERNS}, v AS (SELECT id, status, lower(description) AS plain FROM p)
SELECT id, status, count(*) * 4 AS versions FROM v GROUP BY ALL
""")
def capec_xml_versions(spark, folder):
    """Every pattern in the four text versions."""
    raw = catalogues.read_capec(spark, pattern_file(spark, folder))
    versions = clean.pattern_versions(clean.aggregate_raw_patterns(catalogues.capec_records(raw)))
    return versions.groupBy("id", "status").agg(F.count_distinct("preprocessed_version").alias("versions"))


@query("cwe_xml_records", """
SELECT 'CWE-' || c_custkey AS id, c_name AS name, 'Stable' AS status, 'a ' || c_name AS description, c_mktsegment AS class FROM customer
UNION ALL SELECT DISTINCT 'CWE-' || (-c_nationkey), NULL, NULL, NULL, NULL FROM customer
WHERE c_custkey % 2 = 0 AND -c_nationkey NOT IN (SELECT c_custkey FROM customer)
""")
def cwe_xml_records(spark, folder):
    """Weaknesses, and a placeholder for every parent that the file lacks."""
    raw = catalogues.read_cwe(spark, weakness_file(spark, folder))
    edges = links.related_weaknesses(catalogues.cwe_relations(raw))
    rows = upsert.placeholders(catalogues.cwe_records(raw), "id", edges, "target")
    return rows.select("id", "name", "status", "description", F.get("applicable_platforms", F.lit(0))["Class"].alias("class"))


@query("cwe_xml_edges", """
SELECT 'CWE-' || c_custkey AS source, 'CWE-' || (-c_nationkey) AS target, 'ChildOf' AS nature FROM customer WHERE c_custkey % 2 = 0
""")
def cwe_xml_edges(spark, folder):
    raw = catalogues.read_cwe(spark, weakness_file(spark, folder))
    return links.related_weaknesses(catalogues.cwe_relations(raw))


@query("rebuild_entity", """
SELECT 'CWE-' || c_custkey AS id, 'cwe' AS kind FROM customer
UNION ALL SELECT DISTINCT 'CWE-' || (-c_nationkey), 'cwe' FROM customer WHERE c_custkey % 2 = 0 AND -c_nationkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'CWE-' || c_custkey, 'edge' FROM customer WHERE c_custkey % 2 = 0
""")
def rebuild_entity(spark, folder):
    """Rows of an older version are gone once the weaknesses are built again."""
    root = scratch_dir(spark, "rebuilt")
    stale = spark.range(3).select(F.concat(F.lit("OLD-"), "id").alias("id"))
    write_snapshot(stale, f"{root}/cwe")
    raw = catalogues.read_cwe(spark, weakness_file(spark, folder))
    edges = links.related_weaknesses(catalogues.cwe_relations(raw))
    tables = {"cwe": upsert.placeholders(catalogues.cwe_records(raw), "id", edges, "target"), "cwe_related_weakness": edges}
    refresh.rebuild("CWE", tables, root)
    rows = read_snapshot(spark, f"{root}/cwe").select("id", F.lit("cwe").alias("kind"))
    return rows.union(read_snapshot(spark, f"{root}/cwe_related_weakness").select("source", F.lit("edge")))


@query("cwe_xml_patterns", "SELECT 'CWE-' || c_custkey AS cwe_id, 'CAPEC-' || (c_nationkey * 10) AS capec_id FROM customer")
def cwe_xml_patterns(spark, folder):
    return catalogues.pattern_mentions(catalogues.read_cwe(spark, weakness_file(spark, folder)))
