"""Similarity, keyword and hybrid scores over whole tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrspark.functions.vectors import norm
from corrspark.operators import clean, keyword, similarity, tasks
from corrspark.plans import correlate, encode
from corrspark.session import scratch_dir
from corrspark.sources import writers
from registry import sql_text as S
from registry.base import documents, query, table

MODELS = ["vector", "vector_keyword"]


def centroids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key: sums are taken per dimension, next to the data."""
    dims = rows.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = dims.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
    return lists.select(*keys, F.transform("l", lambda e: e["x"]).alias("vector"))


def catalogue(spark: SparkSession, folder: str, flow: bool = False) -> DataFrame:
    """A pattern per label: six fields, each the mean vector of its members.

    With ``flow`` also four steps of up to two texts.
    """
    rows = table(spark, folder, "embeddings").withColumn("capec_id", F.concat(F.lit("CAPEC-"), "label"))
    fields = centroids(rows.withColumn("slot", F.concat(F.lit("field_"), F.col("vec_id") % 6)), ["capec_id", "slot"])
    out = fields.withColumn("kind", F.lit("field"))
    if flow:
        steps = centroids(rows.withColumn("eighth", F.col("vec_id") % 8), ["capec_id", "eighth"])
        slot = F.concat(F.lit("step_"), F.floor(F.col("eighth") / 2))
        out = out.unionByName(steps.select("capec_id", slot.alias("slot"), "vector", F.lit("flow").alias("kind")))
    return out


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, status) of the patterns; the last one is deprecated."""
    labels = table(spark, folder, "embeddings").select("label").distinct()
    status = F.when(F.col("label") == 9, "Deprecated").when(F.col("label") != 8, "Draft")
    return labels.select(
        F.concat(F.lit("CAPEC-"), "label").alias("id"), F.concat(F.lit("Pattern "), "label").alias("name"), status.alias("status")
    )


def queries_of(spark: SparkSession, folder: str) -> DataFrame:
    truth = F.array(F.concat(F.lit("CAPEC-"), "label")).alias("truth")
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("cve_id"), F.col("embedding").alias("vector"), truth)


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as names and alternate terms of the patterns."""
    rows = table(spark, folder, "benchmark")
    return rows.select(F.concat(F.lit("CAPEC-"), F.col("item_id") % 10).alias("capec_id"), F.col("text").alias("keyword"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("doc_id").alias("cve_id"), "text")


def ranked(spark: SparkSession, folder: str, top: int | None = None, true_only: bool = False) -> DataFrame:
    """Ranks under the vector model and its keyword variant, as one map.

    Only texts that have a vector are searched for keywords. ``true_only`` keeps
    the rank of each vector's own label.
    """
    rows = queries_of(spark, folder)
    asked = texts(spark, folder).join(rows.select("cve_id"), "cve_id", "left_semi")
    hits = keyword.keyword_hits(asked, keywords(spark, folder), stages=("exact",), acronyms={})
    rows = rows.join(hits, "cve_id", "left")
    wanted = "truth" if true_only else None
    return similarity.score_patterns(rows, catalogue(spark, folder), hits="hits", top=top, wanted=wanted)


# --- SQL building blocks ---------------------------------------------------


def _mean_vectors(name: str, slot: str) -> str:
    return f"""
{name}_dims AS (
  SELECT label, {slot} AS slot, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
{name}_means AS (SELECT label, slot, pos, avg(x) AS x FROM {name}_dims GROUP BY ALL),
{name} AS (SELECT label, slot, list(x ORDER BY pos) AS vector FROM {name}_means GROUP BY ALL)"""


HALF_UP = "CAST(sign({0}) * floor(abs({0}) + 0.5) AS BIGINT)"
SCORED = _mean_vectors("fields", "vec_id % 6") + f""",
field_scores AS (
  SELECT vec_id AS cve_id, f.label, f.slot,
         {HALF_UP.format("1000 * list_cosine_similarity(e.embedding::DOUBLE[], f.vector)")} AS milli
  FROM embeddings e, fields f),
sums AS (SELECT cve_id, label, sum(milli)::BIGINT AS s, count(*) AS n FROM field_scores GROUP BY ALL),
finals AS (SELECT cve_id, label, CAST(sign(s) AS BIGINT) * ((2 * abs(s) + n) // (2 * n)) AS milli FROM sums),
base AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY milli DESC, label) AS rank FROM finals)"""
HITS = f"""
doc_forms AS (SELECT doc_id AS cve_id, {S.uniform('text')} AS u FROM documents),
item_forms AS (SELECT item_id % 10 AS label, {S.uniform('text')} AS k FROM benchmark),
hits AS (SELECT DISTINCT cve_id, label FROM doc_forms, item_forms WHERE k <> '' AND contains(u, k))"""
RANKED = SCORED + "," + HITS + """,
boosted AS (
  SELECT b.cve_id, b.label, b.milli + CASE WHEN h.label IS NULL THEN -10 ELSE 300 END AS milli, b.rank AS tie
  FROM base b LEFT JOIN hits h USING (cve_id, label)),
ranked AS (
  SELECT cve_id, 'vector' AS model, 'CAPEC-' || label AS capec_id, milli / 1000.0 AS final_score, rank FROM base
  UNION ALL
  SELECT cve_id, 'vector_keyword', 'CAPEC-' || label, milli / 1000.0,
         row_number() OVER (PARTITION BY cve_id ORDER BY milli DESC, tie) FROM boosted)"""


@query("cosine_rank", f"WITH {SCORED} SELECT cve_id, 'vector' AS model, 'CAPEC-' || label AS capec_id, milli / 1000.0 AS final_score, rank FROM base")
def cosine_rank(spark, folder):
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder))


@query("cosine_rank_blocks", f"WITH {SCORED} SELECT cve_id, 'vector' AS model, 'CAPEC-' || label AS capec_id, milli / 1000.0 AS final_score, rank FROM base")
def cosine_rank_blocks(spark, folder):
    """The same ranks by the way a catalogue too large to broadcast takes."""
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder), limit=16 << 10)


_REPEATED = f"""
WITH {SCORED} SELECT CASE WHEN e.label < 8 THEN e.label % 3 END AS cve_id, 'vector' AS model, 'CAPEC-' || b.label AS capec_id, milli / 1000.0 AS final_score, rank
FROM base b JOIN embeddings e ON e.vec_id = b.cve_id WHERE rank <= 3
"""


def repeated(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Many query vectors per key, some without one: each is ranked by itself."""
    key = F.when(F.col("label") < 8, F.col("label") % 3).alias("cve_id")
    rows = table(spark, folder, "embeddings").select(key, F.col("embedding").alias("vector"))
    return similarity.score_patterns(rows, catalogue(spark, folder), top=3, **options)


@query("repeated_keys", _REPEATED)
def repeated_keys(spark, folder):
    return repeated(spark, folder)


@query("repeated_keys_blocks", _REPEATED)
def repeated_keys_blocks(spark, folder):
    return repeated(spark, folder, limit=16 << 10)


@query("wanted_blocks", f"""
WITH {SCORED} SELECT b.cve_id, 'vector' AS model, 'CAPEC-' || b.label AS capec_id, milli / 1000.0 AS final_score, rank
FROM base b JOIN embeddings e ON e.vec_id = b.cve_id AND e.label = b.label
""")
def wanted_blocks(spark, folder):
    """Ranks of the true patterns; a block hands on how many patterns are better."""
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder), wanted="truth", limit=16 << 10)


@query("hybrid_rank", f"WITH {RANKED} SELECT * FROM ranked")
def hybrid_rank(spark, folder):
    return ranked(spark, folder)


_JOINED = RANKED.replace("WHEN h.label IS NULL THEN -10", "WHEN b.cve_id NOT IN (SELECT doc_id FROM documents) THEN 0 WHEN h.label IS NULL THEN -10")


@query("hybrid_rank_joined", f"WITH {_JOINED} SELECT * FROM ranked")
def hybrid_rank_joined(spark, folder):
    """The hybrid as a join of two score tables; a vector without text scores zero."""
    base = similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder))
    scores = keyword.keyword_scores(texts(spark, folder), keywords(spark, folder), stages=("exact",), acronyms={})
    return similarity.fuse_keyword(base, scores, ["cve_id"])


@query("correlate_topk", f"WITH {RANKED} SELECT * FROM ranked WHERE rank <= 3")
def correlate_topk(spark, folder):
    return ranked(spark, folder, top=3)


_cells = ", ".join(f"max(CASE WHEN rank = {i} THEN capec_id END) AS \"Rank_{i}\", max(CASE WHEN rank = {i} THEN final_score END) AS \"Score_{i}\"" for i in (1, 2, 3))


@query("topk_wide", f"""
WITH {RANKED}, wide AS (SELECT model, cve_id, {_cells} FROM ranked WHERE rank <= 3 GROUP BY ALL)
SELECT d.source AS host, wide.* FROM wide JOIN documents d ON d.doc_id = wide.cve_id
""")
def topk_wide(spark, folder):
    hosts = table(spark, folder, "documents").select(F.col("source").alias("host"), F.col("doc_id").alias("cve_id"))
    return tasks.top_patterns(hosts, ranked(spark, folder, top=3), 3, MODELS)


@query("field_scores_long", f"WITH {SCORED} SELECT cve_id, 'CAPEC-' || label AS capec_id, 'field_' || slot AS field, milli / 1000.0 AS score FROM field_scores")
def field_scores_long(spark, folder):
    return similarity.field_scores(queries_of(spark, folder), catalogue(spark, folder))


@query("final_score", f"WITH {SCORED} SELECT cve_id, 'CAPEC-' || label AS capec_id, milli / 1000.0 AS final_score FROM finals")
def final_score(spark, folder):
    long_rows = similarity.field_scores(queries_of(spark, folder), catalogue(spark, folder))
    return similarity.final_scores(long_rows, ["cve_id", "capec_id"])


_flow = _mean_vectors("parts", "vec_id % 8") + """,
part_scores AS (
  SELECT vec_id AS cve_id, p.label, p.slot // 2 AS step, list_cosine_similarity(e.embedding::DOUBLE[], p.vector) AS score
  FROM embeddings e, parts p),
step_scores AS (
  SELECT cve_id, label, step, CASE WHEN count(*) < 2 THEN greatest(max(score), 0) ELSE max(score) END AS score
  FROM part_scores GROUP BY ALL),
flows AS (SELECT cve_id, label, avg(score) AS flow FROM step_scores GROUP BY ALL)"""


def _flow_sql(weight: int, flow: str) -> str:
    return f"""
WITH {SCORED}, {_flow}, mixed AS (
  SELECT s.cve_id, s.label, {HALF_UP.format(f"((s + 1000 * {weight} * {flow}) / (n + CASE WHEN {flow} <> 0 THEN {weight} ELSE 0 END))")} AS milli
  FROM sums s JOIN flows f ON s.cve_id = f.cve_id AND s.label = f.label)
SELECT cve_id, 'vector' AS model, 'CAPEC-' || label AS capec_id, milli / 1000.0 AS final_score,
       row_number() OVER (PARTITION BY cve_id ORDER BY milli DESC, label) AS rank FROM mixed"""


@query("flow_score", _flow_sql(1, "flow"))
def flow_score(spark, folder):
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder, flow=True))


@query("flow_score_weighted", _flow_sql(2, f"({HALF_UP.format('1000 * flow')} / 1000.0)"))
def flow_score_weighted(spark, folder):
    """The flow, rounded, counts twice in the mean."""
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder, flow=True), flow_weight=2)


@query("flow_score_blocks", _flow_sql(1, "flow"))
def flow_score_blocks(spark, folder):
    return similarity.score_patterns(queries_of(spark, folder), catalogue(spark, folder, flow=True), limit=16 << 10)


@query("flow_score_rows", """
WITH steps AS (SELECT l_orderkey, l_linenumber, CASE WHEN count(*) < 2 THEN greatest(max(0.05 - l_discount), 0) ELSE max(0.05 - l_discount) END AS best
               FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(avg(best), 6) + 0.0 AS flow_score FROM steps GROUP BY ALL
""")
def flow_score_rows(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (0.05 - F.col("l_discount")).alias("score"))
    flows = similarity.flow_scores(rows, ["l_orderkey"], "l_linenumber", "score")
    return flows.select("l_orderkey", (F.round("flow_score", 6) + 0.0).alias("flow_score"))


@query("cosine_pairs", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pairs(spark, folder):
    rows = table(spark, folder, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = similarity.pair_similarity(rows.join(after, "vec_id"), "embedding", "next")
    return pairs.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("one_to_many", """
SELECT a.vec_id, t.field, 'vector' AS method, round(CASE t.field
         WHEN 'next' THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
         ELSE list_cosine_similarity(a.embedding::DOUBLE[], list_reverse(a.embedding)::DOUBLE[]) END, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, (VALUES ('next'), ('reverse')) t(field)
""")
def one_to_many(spark, folder):
    rows = table(spark, folder, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = rows.join(after, "vec_id").select(
        "vec_id", "embedding", F.array(F.lit("next"), F.lit("reverse")).alias("names"), F.array("next", F.reverse("embedding")).alias("vectors")
    )
    out = similarity.one_to_many(pairs, "embedding", "names", "vectors", ["vec_id"])
    return out.withColumn("score", F.round("score", 6))


@query("keyword_exact", f"WITH {HITS} SELECT cve_id, 'CAPEC-' || label AS capec_id FROM hits")
def keyword_exact(spark, folder):
    return keyword.exact_pairs(texts(spark, folder), keywords(spark, folder), "cve_id", "text")


@query("keyword_max", f"""
WITH {HITS} SELECT d.doc_id AS cve_id, 'CAPEC-' || p.label AS capec_id, CASE WHEN h.label IS NULL THEN -0.01::DOUBLE ELSE 0.3::DOUBLE END AS keyword_score
FROM documents d CROSS JOIN (SELECT DISTINCT label FROM item_forms) p LEFT JOIN hits h ON h.cve_id = d.doc_id AND h.label = p.label
""")
def keyword_max(spark, folder):
    return keyword.keyword_scores(texts(spark, folder), keywords(spark, folder), stages=("exact",), acronyms={})


def _content(text: str) -> str:
    """Lower-cased tokens of a uniform text without stop words."""
    return f"[lower(t) FOR t IN regexp_extract_all({S.stop_words(text)}, {S.quote(S.TOKEN)})]"


PARTIAL = f"""
WITH d AS (SELECT doc_id AS cve_id, {S.uniform('text')} AS u FROM documents),
dt AS (SELECT cve_id, u, {_content('u')} AS t FROM d),
k AS (SELECT item_id, item_id % 10 AS label, {S.uniform('text')} AS u FROM benchmark),
kt AS (SELECT item_id, label, u, {_content('u')} AS t, len({_content('u')}) AS n FROM k),
dw AS (SELECT cve_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM dt),
kw AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM kt),
found AS (SELECT cve_id, item_id, count(*) AS found FROM (SELECT DISTINCT cve_id, w FROM dw) JOIN kw USING (w) GROUP BY ALL),
diag AS (SELECT cve_id, item_id, dw.pos - kw.pos AS shift, kw.pos AS pos FROM dw JOIN kw USING (w)),
isle AS (SELECT cve_id, item_id, shift, pos - row_number() OVER (PARTITION BY cve_id, item_id, shift ORDER BY pos) AS isle FROM diag),
run AS (SELECT cve_id, item_id, max(c) AS run FROM (SELECT cve_id, item_id, shift, isle, count(*) AS c FROM isle GROUP BY ALL) GROUP BY ALL),
pairs AS (
  SELECT dt.cve_id, kt.item_id, kt.label, kt.n, coalesce(found, 0) AS found, coalesce(run, 1) AS run,
         (contains(dt.u, kt.u) AND kt.u <> '') OR (kt.n > 0 AND contains(array_to_string(dt.t, ' '), array_to_string(kt.t, ' '))) AS whole,
         kt.n >= 4 AND (contains(array_to_string(dt.t, ' '), array_to_string(kt.t[1:kt.n // 2], ' '))
                     OR contains(array_to_string(dt.t, ' '), array_to_string(kt.t[kt.n // 2 + 1:], ' '))) AS half
  FROM dt CROSS JOIN kt
  LEFT JOIN found ON found.cve_id = dt.cve_id AND found.item_id = kt.item_id
  LEFT JOIN run ON run.cve_id = dt.cve_id AND run.item_id = kt.item_id),
scored AS (
  SELECT cve_id, label, CASE WHEN whole THEN 0.3 WHEN n = 0 THEN 0 ELSE
         0.2 / n * found + least(0.05, 0.05 / n * run * (run - 1) / 2)
         + CASE WHEN half THEN 0.15 WHEN found >= 2 THEN 0.1 ELSE 0 END END AS score FROM pairs),
best AS (SELECT cve_id, label, max(floor(score::DOUBLE * 1000 + 0.5) / 1000) AS score FROM scored GROUP BY ALL)
SELECT cve_id, 'CAPEC-' || label AS capec_id, CASE WHEN score = 0 THEN -0.01 ELSE score END AS keyword_score FROM best
"""


@query("keyword_partial", PARTIAL)
def keyword_partial(spark, folder):
    """The whole cascade with lemmas and stems switched off, which SQL can follow."""
    return keyword.keyword_scores(texts(spark, folder), keywords(spark, folder), acronyms={}, lemma=None, stem=None)


@query("keyword_partial_blocks", PARTIAL)
def keyword_partial_blocks(spark, folder):
    return keyword.keyword_scores(texts(spark, folder), keywords(spark, folder), acronyms={}, lemma=None, stem=None, limit=16 << 10)


@query("keyword_cascade")
def keyword_cascade(spark, folder):
    return keyword.keyword_scores(texts(spark, folder), keywords(spark, folder))


@query("fuzzy_title")
def fuzzy_title(spark, folder):
    """First line of each turn against the turn before it."""
    rows = table(spark, folder, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    pairs = rows.join(before, ["conv_id", "turn"]).withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    scored = keyword.fuzzy_title_scores(pairs, "title", "before")
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("encode_hashed", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
t AS (SELECT doc_id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 128 AS slot, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM t GROUP BY slot),
v AS (SELECT doc_id, CAST(tf * idf AS FLOAT)::DOUBLE AS x FROM t JOIN d USING (slot))
SELECT d.doc_id AS cve_id, CAST(count(x) FILTER (x <> 0) AS INTEGER) AS slots, coalesce(round(sqrt(sum(x * x)), 4), 0) AS norm
FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id
""")
def encode_hashed(spark, folder):
    """Non-zero slots and norm of each text's hashed vector."""
    rows = encode.encode_hashed(128)(texts(spark, folder))
    size = F.size(F.filter("vector", lambda x: x != 0))
    return rows.select("cve_id", size.alias("slots"), F.round(norm(F.col("vector")), 4).alias("norm"))


def _counting(run: int):
    """A model that says which run encoded a text."""
    return lambda: lambda texts: [[float(len(t)), float(t.count(" ")), float(run)] for t in texts]


@query("encode_incremental", """
SELECT doc_id AS cve_id, CAST(length(text) AS INTEGER) AS letters, CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS blanks,
       CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 1 ELSE 2 END AS run
FROM documents
""")
def encode_incremental(spark, folder):
    """Two runs on one store of vectors: the second encodes only texts that the first has not seen."""
    root, rows = scratch_dir(spark, "vectors"), texts(spark, folder)
    encode.encode_incremental(encode.encode_with(_counting(1)), root, "counts")(rows.filter("cve_id % 2 = 0"))
    out = encode.encode_incremental(encode.encode_with(_counting(2)), root, "counts")(rows)
    part = lambda i: F.get("vector", F.lit(i)).cast("int")
    return out.select("cve_id", part(0).alias("letters"), part(1).alias("blanks"), part(2).alias("run"))


@query("field_texts", """
WITH p AS (SELECT 'CAPEC-' || item_id AS capec_id, split_part(text, '.', 1) AS name, text AS description, CASE WHEN item_id % 2 = 0 THEN '' ELSE upper(text) END AS other FROM benchmark)
SELECT capec_id, 'field' AS kind, slot, text FROM (
  SELECT capec_id, 'name' AS slot, name AS text FROM p UNION ALL SELECT capec_id, 'description', description FROM p
  UNION ALL SELECT capec_id, unnest(['prerequisites', 'extended_description']), other FROM p) WHERE text <> ''
""")
def field_texts(spark, folder):
    """The texts that the extended field set compares; empty fields are left out."""
    items = table(spark, folder, "benchmark")
    other = F.when(F.col("item_id") % 2 == 0, "").otherwise(F.upper("text"))
    filled = {"description": F.col("text"), "prerequisites": other, "extended_description": other}
    aggregated = [filled.get(f, F.lit("")).alias(f"{f}_aggregated") for f in similarity.EXTENDED_FIELDS if f != "name"]
    rows = items.select(F.concat(F.lit("CAPEC-"), "item_id").alias("id"), F.split_part("text", F.lit("."), F.lit(1)).alias("name"), *aggregated)
    return similarity.field_texts(rows, similarity.EXTENDED_FIELDS)


@query("model_list", f"""
WITH {RANKED}, l AS (SELECT DISTINCT CASE WHEN cve_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task_id, model FROM ranked WHERE model = 'vector' OR cve_id % 2 = 0)
SELECT task_id, model FROM l
""")
def model_list(spark, folder):
    """Models of finished tasks, read from their stored results; one task has no keyword variant."""
    rows = ranked(spark, folder, top=1).withColumn("task_id", F.when(F.col("cve_id") % 2 == 0, "even").otherwise("odd"))
    path = scratch_dir(spark, "models")
    writers.write_results(rows.filter((F.col("model") == "vector") | (F.col("task_id") == "even")), path)
    return correlate.finished_models(spark.read.parquet(path))


_DOCUMENT = f"""
WITH {SCORED}, {_flow}, {HITS.lstrip()},
mixed AS (
  SELECT s.cve_id, s.label, {HALF_UP.format("((s + 1000 * flow) / (n + CASE WHEN flow <> 0 THEN 1 ELSE 0 END))")} AS milli
  FROM sums s JOIN flows f ON s.cve_id = f.cve_id AND s.label = f.label),
first AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY milli DESC, label) AS rank FROM mixed),
fused AS (SELECT b.cve_id, b.label, b.milli + CASE WHEN h.label IS NULL THEN -10 ELSE 300 END AS milli, b.rank AS tie FROM first b LEFT JOIN hits h USING (cve_id, label)),
whole AS (
  SELECT cve_id, 'vector' AS model, label, milli, rank FROM first
  UNION ALL SELECT cve_id, 'vector_keyword', label, milli, row_number() OVER (PARTITION BY cve_id ORDER BY milli DESC, tie) FROM fused),
kept AS (SELECT * FROM whole WHERE rank <= 4),
named AS (
  SELECT cve_id, label, 'field_' || slot || '_score' AS name, milli / 1000.0::DOUBLE AS score FROM field_scores
  UNION ALL SELECT cve_id, label, 'execution_flow_score', round(flow, 6) + 0.0 FROM flows WHERE flow <> 0)
SELECT 't1' AS task_id, k.cve_id, model, rank, 'CAPEC-' || k.label AS capec_id, name, score FROM kept k JOIN named n ON n.cve_id = k.cve_id AND n.label = k.label
UNION ALL SELECT 't1', cve_id, model, rank, 'CAPEC-' || label, 'final_score', milli / 1000.0::DOUBLE FROM kept
"""


def _document(spark, folder, **options):
    """The stored document of every query, taken apart: each pattern's scores by name."""
    rows = queries_of(spark, folder)
    asked = texts(spark, folder).join(rows.select("cve_id"), "cve_id", "left_semi")
    hits = keyword.keyword_hits(asked, keywords(spark, folder), stages=("exact",), acronyms={})
    scored = similarity.score_patterns(rows.join(hits, "cve_id", "left"), catalogue(spark, folder, flow=True), hits="hits", top=4, scores=True, **options)
    path = scratch_dir(spark, "document")
    writers.write_results(scored.withColumn("task_id", F.lit("t1")), path)
    document = writers.similarity_document(spark.read.schema(f"cve_id long, capec_id string, final_score double, rank int, {similarity.SCORES}, task_id string, model string").parquet(path), ["task_id", "cve_id"])
    patterns = document.select("task_id", "cve_id", F.explode("similarity_scores").alias("model", "patterns")).select("task_id", "cve_id", "model", F.explode("patterns").alias("p"))
    every = F.map_concat("p.scores", F.create_map(F.lit("final_score"), F.col("p.final_score")))
    named = patterns.select("task_id", "cve_id", "model", "p.rank", "p.capec_id", F.explode(every).alias("name", "score"))
    return named.withColumn("score", F.when(F.col("name") == "execution_flow_score", F.round("score", 6) + 0.0).otherwise(F.col("score")))


@query("correlation_document", _DOCUMENT)
def correlation_document(spark, folder):
    return _document(spark, folder)


@query("correlation_document_blocks", _DOCUMENT)
def correlation_document_blocks(spark, folder):
    return _document(spark, folder, limit=16 << 10)


@query("stored_results", f"WITH {RANKED} SELECT 't1' AS task_id, * FROM ranked WHERE rank <= 2")
def stored_results(spark, folder):
    """Results written twice under one task: the second run replaces the first."""
    path = scratch_dir(spark, "results")
    rows = ranked(spark, folder, top=2).withColumn("task_id", F.lit("t1"))
    for _ in range(2):
        writers.write_results(rows, path)
    return spark.read.parquet(path).select("task_id", "cve_id", "model", "capec_id", "final_score", "rank")


def _hard_to_encode():
    """A model that takes no text with three hash signs."""

    def run(texts: list[str]):
        if any("###" in t for t in texts):
            raise ValueError("this text can't be encoded")
        return [[1.0, float(len(t))] for t in texts]

    return run


@query("correlation_errors", """
SELECT doc_id AS cve_id, 'no vector' AS error, 'picky' AS model FROM documents WHERE contains(text, '###')
UNION ALL SELECT -doc_id - 1, 'not found', NULL FROM documents WHERE doc_id % 50 = 0
""")
def correlation_errors(spark, folder):
    """Ids that are missing or that a model can't encode are reported; the rest goes on."""
    cves = documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    ids = table(spark, folder, "documents").select(F.col("doc_id").alias("cve_id"))
    asked = ids.union(ids.filter("cve_id % 50 = 0").select(-F.col("cve_id") - 1))
    rows = table(spark, folder, "benchmark").select(
        F.concat(F.lit("CAPEC-"), "item_id").alias("id"), F.lit("a name").alias("name"), F.lit("Draft").alias("status"),
        F.array().cast("array<string>").alias("alternate_terms"), F.lower("text").alias("description_aggregated"),
        *[F.lit("").alias(f"{f}_aggregated") for f in similarity.FIELDS if f not in ("name", "description")],
    )
    _, errors = correlate.correlate(asked, cves, rows, {"picky": encode.encode_with(_hard_to_encode)}, options=clean.CleanOptions(**{f.name: False for f in dataclasses.fields(clean.CleanOptions)}), top=1)
    return errors.drop("task_id")


@query("text_correlation")
def text_correlation(spark, folder):
    """The whole plan on texts: clean, keywords, vectors, fusion, ranks."""
    cves = documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    requests = table(spark, folder, "documents").select(F.col("doc_id").alias("cve_id"))
    items = table(spark, folder, "benchmark")
    nothing = F.lit("")
    rows = items.select(
        F.concat(F.lit("CAPEC-"), "item_id").alias("id"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("name"),
        F.lit("Draft").alias("status"),
        F.array().cast("array<string>").alias("alternate_terms"),
        F.col("text").alias("description_aggregated"),
        *[nothing.alias(f"{f}_aggregated") for f in ("prerequisites", "resources_required", "mitigations", "skills_required")],
    )
    results, _ = correlate.correlate(requests, cves, rows, {"hashed": encode.encode_hashed(64)}, top=5)
    return results.drop("task_id")
