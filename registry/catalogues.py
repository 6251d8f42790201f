"""Feeds, upserts, links, lookups and requests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrspark import schemas
from corrspark.functions import records as R
from corrspark.operators import control, grams, links, sample, tasks, upsert
from corrspark.plans import refresh
from corrspark.session import dealt, materialise
from corrspark.sources import cve, inputs, writers
from registry.base import documents, placed, query, table
from registry.scores import RANKED, patterns, ranked

# --- feed items out of the tables ------------------------------------------


def feed(spark: SparkSession, folder: str, labels: DataFrame | None = None) -> DataFrame:
    """Each document as a feed file with one item, in the feed's own schema."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels") if labels is None else labels, "doc_id", "left")
    json = F.to_json(F.struct(
        F.lit("2024-01-01T07:00Z").alias("CVE_data_timestamp"),
        F.lit("CVE").alias("CVE_data_type"),
        F.array(F.struct(
            F.struct(
                F.struct(F.concat(F.lit("CVE-2024-"), F.col("doc_id")).alias("ID"), F.col("source").alias("ASSIGNER")).alias("CVE_data_meta"),
                F.struct(F.array(F.struct("lang", F.col("text").alias("value"))).alias("description_data")).alias("description"),
                F.struct(F.array(
                    F.struct(F.concat(F.lit("http://a/"), "source").alias("url"), F.col("source").alias("name"), F.array("lang").alias("tags")),
                    F.struct(F.concat(F.lit("http://b/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("tags")),
                ).alias("reference_data")).alias("references"),
                F.struct(F.array(F.struct(F.array(
                    F.struct("lang", F.concat(F.lit("CWE-"), "quality").alias("value")),
                    F.struct(F.lit("en").alias("lang"), F.lit("NVD-CWE-Other").alias("value")),
                ).alias("description"))).alias("problemtype_data")).alias("problemtype"),
            ).alias("cve"),
            F.struct(F.array(F.struct(F.array(
                F.struct((F.col("quality") == 1).alias("vulnerable"), F.concat(F.lit("cpe:2.3:a:v:"), "source").alias("cpe23Uri")),
                F.struct(F.lit(False).alias("vulnerable"), F.concat(F.lit("cpe:2.3:o:v:"), "lang").alias("cpe23Uri")),
            ).alias("cpe_match"))).alias("nodes")).alias("configurations"),
            F.lit("2024-02-03T04:05Z").alias("publishedDate"),
            F.when(F.col("lang") == "de", "soon").otherwise("2024-02-03T04:05Z").alias("lastModifiedDate"),
        )).alias("CVE_Items"),
    ))
    return rows.select(F.from_json(json, schemas.CVE_FEED).alias("f")).select("f.*")


@query("refresh_links", """
SELECT 'CVE-2024-' || doc_id AS cve_id, 'CWE-' || CASE WHEN doc_id % 3 = 0 THEN quality ELSE 1 - quality END AS cwe_id
FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND doc_id % 10 <> 0 AND quality IS NOT NULL
""")
def refresh_links(spark, folder):
    """Links over two feeds: the second holds some records again with other mentions.

    One weakness arrives with the second feed, some records are deleted with it; the
    links of the first feed are carried on and only what changed is linked.
    """
    flipped = table(spark, folder, "labels").withColumn("quality", 1 - F.col("quality"))
    number = F.regexp_extract(F.get("CVE_Items", F.lit(0))["cve"]["CVE_data_meta"]["ID"], r"(\d+)$", 1).cast("long") % 3
    feeds = [feed(spark, folder).filter(number != 2), feed(spark, folder, flipped).filter(number != 0)]
    weaknesses = [spark.range(n).select(F.concat(F.lit("CWE-"), "id").alias("id")) for n in (1, 2)]
    done, before, tables = None, None, {}
    for rows, known in zip(feeds, weaknesses):
        tables = refresh.feed_tables(rows.withColumn("file_year", F.lit(2024)), tables.get("cve"), tables.get("cve_reference"), tables.get("weakness_mentions"))
        if done is not None:
            doomed = tables["cve"].filter(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 10 == 0)
            tables["cve"] = upsert.delete_keys(tables["cve"], doomed, "id")
        tables |= {n: materialise(tables[n], n) for n in ("cve", "weakness_mentions")}
        bridges = refresh.link_tables(tables, {"cwe": known, "pattern_mentions": _no_mentions(spark), "refreshed": known}, {"capec": known}, done, before)
        done, before = {"cve_cwe": materialise(bridges["cve_cwe"], "bridge")}, {"cve": tables["cve"], "cwe": known}
    return done["cve_cwe"]


def _no_mentions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cwe_id string, capec_id string")


@query("feed_records", """
SELECT 'CVE-2024-' || doc_id AS id, source AS assigner, text AS description, 1706933100 AS published,
       CASE WHEN quality = 1 THEN 'cpe:2.3:a:v:' || source ELSE '' END AS vulnerable,
       CASE WHEN quality = 1 THEN '' ELSE 'cpe:2.3:a:v:' || source || '|' END || 'cpe:2.3:o:v:' || lang AS related
FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'
""")
def feed_records(spark, folder):
    rows = cve.accepted(cve.records(feed(spark, folder)))
    return rows.select(
        "id", "assigner", "description", F.unix_timestamp("published_date").alias("published"),
        F.array_join("vulnerable_cpe_uris", "|").alias("vulnerable"), F.array_join("related_cpe_uris", "|").alias("related"),
    )


@query("feed_quarantine", "SELECT 'CVE-2024-' || doc_id AS id, false AS has_description, lang <> 'de' AS has_date FROM documents WHERE lang <> 'en'")
def feed_quarantine(spark, folder):
    rows = cve.quarantined(cve.records(feed(spark, folder)))
    return rows.select("id", F.col("description").isNotNull().alias("has_description"), F.col("last_modified_date").isNotNull().alias("has_date"))


@query("feed_references", """
SELECT 'CVE-2024-' || doc_id AS cve_id, 'http://a/' || source AS url, source AS name, lang AS tags FROM documents
UNION ALL SELECT 'CVE-2024-' || doc_id, 'http://b/' || doc_id, NULL, '' FROM documents
""")
def feed_references(spark, folder):
    return cve.references(feed(spark, folder)).select("cve_id", "url", "name", F.array_join("tags", ",").alias("tags"))


@query("feed_weaknesses", "SELECT 'CVE-2024-' || doc_id AS cve_id, 'CWE-' || quality AS cwe_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en'")
def feed_weaknesses(spark, folder):
    return cve.weakness_mentions(feed(spark, folder))


@query("feed_times", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) END AS seconds FROM events
""")
def feed_times(spark, folder):
    rows = table(spark, folder, "events")
    text = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")).otherwise("not a time")
    return rows.select("event_id", F.unix_timestamp(cve.parse_time(text)).alias("seconds"))


@query("feed_version", "SELECT strftime(max(ts), '%Y-%m-%d') AS version FROM events")
def feed_version(spark, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("CVE_data_timestamp")
    return cve.feed_version(table(spark, folder, "events").select(stamp))


@query("step_suffix", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT conv_id, turn, role || CASE WHEN i > 1 THEN chr((96 + i)::INT) ELSE '' END AS step FROM n
""")
def step_suffix(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.col("role").alias("step"))
    return links.number_steps(rows, "conv_id", "step", "turn")


_ids = "'CVE-' || year(o_orderdate) || '-' || o_orderkey"


@query("valid_ids", f"SELECT DISTINCT x AS cve_id FROM (SELECT {_ids} AS x FROM orders) WHERE regexp_matches(x, '^CVE-\\d{{4}}-\\d{{4,7}}$')")
def valid_ids(spark, folder):
    ids = F.expr(_ids)
    text = F.concat(ids, F.lit(" , "), F.col("o_orderpriority"), F.lit(","), ids)
    return inputs.ids_from_text(table(spark, folder, "orders").select(text.alias("line")), "line")


@query("cell_ids", f"SELECT DISTINCT x AS cve_id FROM (SELECT {_ids} AS x FROM orders) WHERE regexp_matches(x, '^CVE-\\d{{4}}-\\d{{4,7}}$')")
def cell_ids(spark, folder):
    return inputs.ids_from_cells(table(spark, folder, "orders").select("o_orderstatus", F.expr(_ids).alias("id"), "o_orderpriority"))


@query("host_ids", f"SELECT DISTINCT o_custkey AS host, {_ids} AS cve_id FROM orders WHERE o_orderkey >= 1000")
def host_ids(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("host"), F.expr(_ids).alias("id"), "o_orderpriority")
    return inputs.ids_from_cells(rows, ("host",))


@query("truth_last_wins", """
WITH e AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
last AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM e GROUP BY ALL)
SELECT 'CVE-' || o_custkey AS cve_id, unnest(['CAPEC-' || p, 'CAPEC-x']) AS capec_id FROM last
""")
def truth_last_wins(spark, folder):
    """Entries per customer; entries without a list are skipped."""
    listed = F.when(F.col("o_orderstatus") != "P", F.array(F.concat(F.lit("CAPEC-"), "o_orderpriority"), F.lit("CAPEC-x")))
    entries = table(spark, folder, "orders").select(
        F.concat(F.lit("CVE-"), "o_custkey").alias("CVE_ID"), listed.alias("Assigned_CAPEC_ID"), F.col("o_orderkey").alias("pos")
    )
    return inputs.truth_pairs(entries)


@query("truth_from_lists", """
SELECT p_brand || t.tag AS cve_id, trim(x) AS capec_id FROM part,
  (VALUES ('a'), ('b')) t(tag), unnest(string_split(CASE WHEN t.tag = 'a' THEN p_type || ', ' || p_name ELSE ' , ' || p_name END, ',')) u(x)
WHERE trim(x) <> ''
""")
def truth_from_lists(spark, folder):
    ids = F.array(F.concat("p_brand", F.lit("a")), F.concat("p_brand", F.lit("b")))
    sets = F.array(F.concat("p_type", F.lit(", "), "p_name"), F.concat(F.lit(" , "), "p_name"))
    return inputs.truth_from_lists(table(spark, folder, "part"), ids, sets)


# --- upserts and control ---------------------------------------------------


@query("upsert_last_wins", """
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id
""")
def upsert_last_wins(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return upsert.last_per_key(rows, ["user_id"], ["event_id"])


@query("upsert_composite", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def upsert_composite(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return upsert.last_per_key(rows, ["user_id", "event_type"], ["event_id"])


@query("upsert_snapshot", """
WITH new AS (SELECT l_orderkey AS o_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS status FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(new.status, o_orderstatus) AS status FROM orders FULL JOIN new USING (o_orderkey)
""")
def upsert_snapshot(spark, folder):
    old = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("status"), "l_linenumber", "l_partkey", "l_suppkey")
    return upsert.upsert(old, new, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("replace_children", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0
UNION ALL SELECT l_orderkey, l_linenumber + 10, l_quantity * 2 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1
""")
def replace_children(spark, folder):
    """Every third order comes with new lines; the others keep theirs."""
    old = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    again = table(spark, folder, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = old.filter("l_orderkey % 3 = 0 and l_linenumber = 1").select("l_orderkey", (F.col("l_linenumber") + 10).alias("l_linenumber"), (F.col("l_quantity") * 2).alias("l_quantity"))
    return upsert.replace_children(old, new, again, "l_orderkey")


@query("placeholder_rows", """
SELECT n_nationkey, n_name FROM nation
UNION ALL SELECT DISTINCT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)
""")
def placeholder_rows(spark, folder):
    known = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return upsert.placeholders(known, "n_nationkey", table(spark, folder, "customer"), "c_custkey")


@query("delete_keys", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_keys(spark, folder):
    return upsert.delete_keys(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id")


def _control(spark, folder):
    """One control row per event type: last seen time and a frequency in days."""
    rows = table(spark, folder, "events").groupBy("event_type").agg(F.max("ts").alias("last"), F.count_distinct("user_id").alias("users"))
    return rows.select(
        F.col("event_type").alias("name"), F.col("last").alias("last_update"),
        F.lit(None).cast("timestamp_ntz").alias("next_scheduled_update"),
        (F.col("event_type") == "click").alias("has_been_updated"),
        F.when(F.col("event_type") != "view", F.length("event_type")).alias("update_frequency"),
        F.lit("1").alias("version"), F.lit("Pending").alias("status"),
    )


@query("refresh_schedule", """
WITH c AS (SELECT event_type AS name, max(ts) AS last, CASE WHEN event_type <> 'view' THEN length(event_type) END AS days FROM events GROUP BY event_type)
SELECT name, CAST(last AS DATE)::VARCHAR AS last_day,
       CASE WHEN name <> 'click' AND days > 0 THEN (CAST(last AS DATE) + CAST(days AS INT))::VARCHAR END AS next_day,
       true AS has_been_updated, CASE WHEN name = 'error' THEN '2' ELSE '1' END AS version
FROM c
""")
def refresh_schedule(spark, folder):
    """Every entity but one is refreshed at its last time; one gets a new version."""
    known = _control(spark, folder)
    done = known.filter(F.col("name") != "click").select("name", F.when(F.col("name") == "error", "2").alias("version"), "last_update")
    out = control.record_refresh(known, done)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("name", day("last_update").alias("last_day"), day("next_scheduled_update").alias("next_day"), "has_been_updated", "version")


@query("refresh_state", "SELECT true AS needs_update, false AS all_require_update, true AS all_in_progress FROM (SELECT 1 FROM events LIMIT 1)")
def refresh_state(spark, folder):
    return control.refresh_state(control.on_publish(_control(spark, folder)))


@query("control_status", "SELECT DISTINCT event_type AS name, CASE WHEN event_type = 'error' THEN 'Complete' ELSE 'Pending' END AS status FROM events")
def control_status(spark, folder):
    running = control.set_status(control.on_publish(_control(spark, folder)), "Complete", name="error")
    return control.on_failure(running).select("name", "status")


@query("statistics_freshness", """
SELECT s.event_type, s.stamp >= l.last AS fresh FROM (SELECT event_type, max(ts) AS stamp FROM events GROUP BY ALL) s, (SELECT max(ts) AS last FROM events WHERE event_type = 'click') l
""")
def statistics_freshness(spark, folder):
    rows = table(spark, folder, "events")
    last = rows.filter(F.col("event_type") == "click").agg(F.max("ts")).scalar()
    stamps = rows.groupBy("event_type").agg(F.max("ts").alias("stamp"))
    return stamps.select("event_type", writers.is_fresh(F.col("stamp"), last).alias("fresh"))


# --- links and lookups -----------------------------------------------------


@query("typed_links", """
SELECT DISTINCT l_orderkey AS cve_id, l_suppkey AS cwe_id FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
""")
def typed_links(spark, folder):
    mentions = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("cve_id"), F.col("l_suppkey").alias("cwe_id"))
    left = table(spark, folder, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"))
    right = table(spark, folder, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("id"))
    return links.link(mentions, left, "cve_id", right, "cwe_id")


_edges = "l_partkey AS source, l_suppkey AS target, l_returnflag AS nature, l_linestatus AS view_id, l_orderkey * 10 + l_linenumber AS pos"


@query("weakness_edges", f"SELECT source, target, arg_max(nature, pos) AS nature FROM (SELECT {_edges} FROM lineitem) WHERE view_id = 'O' GROUP BY ALL")
def weakness_edges(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(*[e.strip() for e in _edges.split(",")])
    return links.related_weaknesses(rows, "O")


@query("pattern_edges", f"""
SELECT source, target, arg_max(nature, pos) AS nature FROM (SELECT {_edges} FROM lineitem)
WHERE source IN (SELECT s_suppkey FROM supplier) AND target IN (SELECT s_suppkey FROM supplier) GROUP BY ALL
""")
def pattern_edges(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(*[e.strip() for e in _edges.split(",")])
    return links.related_patterns(rows, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id")))


@query("existing_ids", "SELECT o_orderkey AS cve_id, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def existing_ids(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("cve_id"), "o_orderstatus")
    return links.existing(ids, table(spark, folder, "documents"), "cve_id", "doc_id")


@query("rows_by_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_by_ids(spark, folder):
    ids = table(spark, folder, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("cve_id"))
    return links.by_ids(table(spark, folder, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("active_patterns", """
SELECT doc_id, CASE toxic WHEN 1 THEN 'Deprecated' WHEN 0 THEN 'Draft' END AS status FROM documents LEFT JOIN labels USING (doc_id)
WHERE lang = 'en' AND toxic IS DISTINCT FROM 1
""")
def active_patterns(spark, folder):
    status = F.when(F.col("toxic") == 1, "Deprecated").when(F.col("toxic") == 0, "Draft")
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("lang").alias("preprocessed_version"), status.alias("status"))
    return links.active_patterns(rows, "en").select("doc_id", "status")


@query("search_exact", "SELECT c_name, c_nationkey FROM customer WHERE c_name = 'Customer#000000012'")
def search_exact(spark, folder):
    return links.search(table(spark, folder, "customer").select("c_name", "c_nationkey"), "c_name", "Customer#000000012")


@query("search_prefix", "SELECT c_name, c_nationkey FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def search_prefix(spark, folder):
    return links.search(table(spark, folder, "customer").select("c_name", "c_nationkey"), "c_name", "Customer#00000001")


@query("suggestions", "SELECT c_name AS id, c_mktsegment AS detail FROM customer WHERE contains(upper(c_name), 'R#00000010') ORDER BY id LIMIT 10")
def suggestions(spark, folder):
    return links.suggestions(table(spark, folder, "customer"), "c_name", "r#00000010", F.col("c_mktsegment"))


@query("browse", """
SELECT doc_id, lang, source, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS place
FROM documents WHERE contains(lower(text), 'ther') AND lang = 'en' AND source = 'src3'
""")
def browse(spark, folder):
    rows = links.browse(table(spark, folder, "documents"), "THER", ("doc_id", "text"), {"lang": "en", "source": "src3"}, [F.desc("n_chars"), F.col("doc_id")])
    return placed(rows.select("doc_id", "lang", "source"))


@query("indexed_search", """
SELECT 'documents' AS found_in, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(lower(text), 'ther th') OR contains(lower(source), 'ther th')
UNION ALL SELECT 'short', CAST(doc_id AS VARCHAR) FROM documents WHERE contains(lower(source), 'c3')
UNION ALL SELECT 'suggested', id FROM (SELECT c_name AS id FROM customer WHERE contains(upper(c_name), 'R#00000010') ORDER BY id LIMIT 10)
""")
def indexed_search(spark, folder):
    """Substrings by a posting index over all texts; a query too short for the index; suggestions."""
    docs, people = documents(spark, folder), table(spark, folder, "customer")
    found = lambda name, rows: rows.select(F.lit(name).alias("found_in"), F.col("id").cast("string").alias("id"))
    path = grams.build(docs, "doc_id", ("text", "source"))
    hits = grams.search(docs, "doc_id", ("text", "source"), "Ther TH", path).withColumnRenamed("doc_id", "id")
    short = grams.search(docs, "doc_id", ("source",), "C3", path).withColumnRenamed("doc_id", "id")
    names = grams.suggestions(people, "c_name", "r#00000010", grams.build(people, "c_name", ("c_name",)), F.col("c_mktsegment"))
    return found("documents", hits).union(found("short", short)).union(found("suggested", names))


@query("facet_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def facet_counts(spark, folder):
    return links.facet_counts(table(spark, folder, "documents"), "source")


@query("detail_links", """
SELECT 4 AS id, s_suppkey AS linked_id, s_name AS linked_name
FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 4) JOIN supplier ON l_suppkey = s_suppkey
""")
def detail_links(spark, folder):
    bridge = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return links.detail(parts, 4, bridge, "part", "supplier", suppliers)


# --- labels and accessors --------------------------------------------------


@query("record_labels", f"""
SELECT o_orderkey, {_ids} AS id, CAST(year(o_orderdate) AS INT) AS year, 'https://nvd.nist.gov/vuln/detail/' || {_ids} AS link,
       'https://capec.mitre.org/data/definitions/' || o_custkey || '.html' AS capec_link, CAST(o_custkey AS INT) AS number,
       NOT starts_with(o_orderpriority, '1') AS valid
FROM orders
""")
def record_labels(spark, folder):
    ids, capec = F.expr(_ids), F.concat(F.lit("CAPEC-"), "o_custkey")
    note = F.when(F.startswith("o_orderpriority", F.lit("1")), "Rejected reason: old").otherwise(F.col("o_orderpriority"))
    return table(spark, folder, "orders").select(
        "o_orderkey", ids.alias("id"), R.cve_year(ids).alias("year"), R.nvd_link(ids).alias("link"),
        R.capec_link(capec).alias("capec_link"), R.capec_number(capec).alias("number"), R.is_valid_record(note).alias("valid"),
    )


@query("id_order", f"""
SELECT {_ids} AS id, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS number FROM orders UNION ALL SELECT o_orderpriority || o_orderkey, NULL, NULL FROM orders
""")
def id_order(spark, folder):
    """Ids with their sort key, in its order: malformed ids last."""
    orders = table(spark, folder, "orders")
    rows = orders.select(F.expr(_ids).alias("id")).unionByName(orders.select(F.concat("o_orderpriority", "o_orderkey").alias("id")))
    year, number = R.cve_key(F.col("id"))
    return rows.orderBy(*R.cve_sort_key(F.col("id")), "id").select("id", year.alias("year"), number.alias("number"))


@query("rank_colours", """
SELECT l_orderkey, l_linenumber, CASE WHEN q = 1 THEN 'dark green' WHEN q <= 10 THEN 'light green' WHEN q <= 30 THEN 'yellow' WHEN q <= 50 THEN 'orange' ELSE 'red' END AS colour,
       CASE WHEN q = 1 THEN 'gold' WHEN q <= 5 THEN 'darkgreen' WHEN q <= 10 THEN 'lightgreen' WHEN q <= 20 THEN 'orange' ELSE 'red' END AS edge
FROM (SELECT *, CAST(l_quantity AS INT) + l_linenumber - 1 AS q FROM lineitem)
""")
def rank_colours(spark, folder):
    rank = F.col("l_quantity").cast("int") + F.col("l_linenumber") - 1
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", R.rank_colour(rank).alias("colour"), R.edge_colour(rank).alias("edge"))


@query("cvss_fields", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE 'N/A' END AS v2_vector, 'N/A' AS v2_complexity,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'Impact V3 data is not available.' END AS v3_severity,
       CASE WHEN o_orderstatus = 'O' THEN 'No scope information available.' ELSE 'Impact V3 data is not available.' END AS v3_scope,
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'N/A' END AS v3_info
FROM orders
""")
def cvss_fields(spark, folder):
    none = F.lit(None).cast("string")
    v2 = F.struct(F.struct(F.col("o_orderpriority").alias("vectorString"), none.alias("accessComplexity")).alias("cvssV2"))
    v3 = F.struct(F.struct(F.col("o_orderpriority").alias("baseSeverity"), none.alias("scope")).alias("cvssV3"))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", v2).alias("v2"), F.when(F.col("o_orderstatus") == "O", v3).alias("v3")
    )
    v2, v3 = F.col("v2"), F.col("v3")
    return rows.select(
        "o_orderkey", R.cvss_v2(v2, "vectorString").alias("v2_vector"), R.cvss_v2(v2, "accessComplexity").alias("v2_complexity"),
        R.cvss_v3(v3, "baseSeverity").alias("v3_severity"), R.cvss_v3(v3, "scope").alias("v3_scope"),
        R.cvss_v3_info(v3, "baseSeverity").alias("v3_info"),
    )


# --- samples ---------------------------------------------------------------


@query("sample_per_year", """
SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999
QUALIFY row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(o_orderkey || '#7'), o_orderkey) <= 25
""")
def sample_per_year(spark, folder):
    return sample.per_year(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate", 25, 1996, 1999, 7).select("o_orderkey")


@query("sample_uniform", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || '#3'), p_partkey LIMIT 40")
def sample_uniform(spark, folder):
    return sample.uniform(table(spark, folder, "part").select("p_partkey", "p_name"), "p_partkey", 40, 3)


# --- requests, tasks, graph ------------------------------------------------


def requests(spark, folder):
    """Documents requested by their source and by the segment that shares their key."""
    rows = table(spark, folder, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("cve_id"))
    others = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("host"), F.col("c_custkey").alias("cve_id"))
    return rows.unionByName(others)


REQUESTS = "requests AS (SELECT source AS host, doc_id AS cve_id FROM documents UNION ALL SELECT c_mktsegment, c_custkey FROM customer)"


@query("invert_hosts", f"WITH {REQUESTS} SELECT DISTINCT cve_id, host, count(*) OVER (PARTITION BY cve_id) AS n_hosts FROM (SELECT DISTINCT * FROM requests)")
def invert_hosts(spark, folder):
    return tasks.invert_hosts(requests(spark, folder))


@query("truth_requests", "SELECT DISTINCT 't1' AS task_id, l_suppkey AS cve_id, 'Generic' AS host FROM lineitem")
def truth_requests(spark, folder):
    return tasks.truth_requests(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cve_id")), "t1")


@query("task_page", f"WITH {REQUESTS} SELECT DISTINCT host, r.cve_id, d.lang AS description FROM requests r JOIN embeddings e ON e.vec_id = r.cve_id JOIN documents d ON d.doc_id = r.cve_id")
def task_page(spark, folder):
    results = table(spark, folder, "embeddings").select(F.col("vec_id").alias("cve_id"))
    cves = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("description"))
    asked = requests(spark, folder).withColumn("cve_id", F.col("cve_id"))
    return tasks.task_page(asked, cves, results)


@query("completeness", """
WITH asked AS (SELECT DISTINCT o_orderstatus AS task_id, o_orderkey AS cve_id FROM orders),
done AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS task_id, l_orderkey AS cve_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT task_id, requested, complete, complete - inside AS foreign, requested = complete AND complete = inside AS is_complete FROM (
  SELECT task_id, count(DISTINCT a.cve_id) AS requested, count(DISTINCT d.cve_id) AS complete, count(DISTINCT CASE WHEN a.cve_id IS NOT NULL THEN d.cve_id END) AS inside
  FROM (SELECT task_id, cve_id AS x, cve_id FROM asked) a FULL JOIN (SELECT task_id, cve_id AS x, cve_id FROM done) d USING (task_id, x) GROUP BY task_id)
""")
def completeness(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    asked = orders.select(F.col("o_orderstatus").alias("task_id"), F.col("o_orderkey").alias("cve_id"))
    items = dealt(table(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey")
    done = items.join(dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    moved = F.when(F.col("l_orderkey") % 3 == 0, "P").otherwise(F.col("o_orderstatus"))
    done = done.select(moved.alias("task_id"), F.col("l_orderkey").alias("cve_id")).distinct().withColumn("status", F.lit("complete"))
    return tasks.completeness(asked, done)


GRAPH = RANKED + "," + REQUESTS + """,
owned AS (SELECT cve_id, min(host) AS host FROM requests GROUP BY cve_id),
chosen AS (SELECT host, cve_id FROM owned QUALIFY row_number() OVER (PARTITION BY host ORDER BY cve_id) <= 15),
edges AS (
  SELECT host AS source, cve_id::VARCHAR AS target, 'host' AS kind, NULL::INT AS rank FROM chosen
  UNION ALL
  SELECT cve_id::VARCHAR, capec_id, 'cve', rank FROM ranked WHERE model = 'vector_keyword' AND rank <= 5 AND cve_id IN (SELECT cve_id FROM chosen))"""


@query("graph_selection", f"WITH {GRAPH} SELECT * FROM chosen")
def graph_selection(spark, folder):
    return tasks.graph_selection(requests(spark, folder), 15)


@query("graph_edges", f"WITH {GRAPH} SELECT * FROM edges")
def graph_edges(spark, folder):
    chosen = tasks.graph_selection(requests(spark, folder), 15)
    return tasks.graph_edges(chosen, ranked(spark, folder, top=5), patterns(spark, folder), "vector_keyword")


@query("graph_nodes", f"""
WITH {GRAPH} SELECT DISTINCT host AS id, 'host' AS type, host AS label FROM chosen
UNION ALL SELECT cve_id::VARCHAR, 'cve', coalesce(d.lang, 'No description available.') FROM chosen LEFT JOIN documents d ON d.doc_id = cve_id
UNION ALL SELECT DISTINCT target, 'capec', 'Pattern ' || split_part(target, '-', 2) FROM edges WHERE kind = 'cve'
""")
def graph_nodes(spark, folder):
    chosen = tasks.graph_selection(requests(spark, folder), 15)
    edges = tasks.graph_edges(chosen, ranked(spark, folder, top=5), patterns(spark, folder), "vector_keyword")
    cves = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("description"))
    return tasks.graph_nodes(chosen, edges, cves, patterns(spark, folder))


@query("step_nodes", "SELECT conv_id || '_step_' || (turn + 1) AS id, conv_id::VARCHAR AS parent, turn::VARCHAR AS step, role AS phase FROM conversations")
def step_nodes(spark, folder):
    rows = table(spark, folder, "conversations")
    steps = rows.select(F.col("conv_id").cast("string").alias("capec_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("step"), F.col("role").alias("phase"))
    return tasks.step_nodes(steps)
