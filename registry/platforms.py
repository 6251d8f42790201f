"""Platform names derived from line items, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.operators import cpe
from corrspark.session import spread
from registry.base import documents, line_items, query, table

_part = "CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'h' WHEN 'R' THEN 'o' END"
_uri = (
    f"'cpe:2.3:' || {_part} || ':' || replace(s_name, '#', '_') || ':' || replace(p_name, ' ', '_') || ':' || l_linenumber || ':'"
    " || CASE WHEN l_linestatus = 'F' THEN '-' ELSE 'sp' || l_linenumber END || ':*:*:*:' || lower(p_type) || CASE WHEN l_tax > 0.02 THEN ':*:*' ELSE '' END"
)
URIS = f"""
uris AS (SELECT l_orderkey, l_linenumber, {_uri} AS uri, l_orderkey * 10 + l_linenumber AS pos
         FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
parts AS (SELECT *, string_split(uri, ':') AS p FROM uris)"""


def uris(spark, folder):
    rows = line_items(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", F.expr(_uri).alias("uri"), F.expr("l_orderkey * 10 + l_linenumber").alias("pos"))


@query("cpe_parse", f"""
WITH {URIS} SELECT l_orderkey, l_linenumber, p[3] AS part, p[4] AS vendor, p[5] AS product, p[6] AS version, p[7] AS update, p[8] AS edition,
  p[10] AS sw_edition, p[9] AS language, p[11] AS target_sw FROM parts WHERE len(p) >= 11
""")
def cpe_parse(spark, folder):
    return cpe.parse_uris(uris(spark, folder), "uri").drop("uri", "pos")


@query("cpe_aggregate", f"""
WITH {URIS}, long AS (SELECT p[3] AS part, p[4] AS vendor, p[5] AS product, pos, unnest(['version', 'update', 'target_sw']) AS f, unnest([p[6], p[7], p[11]]) AS v FROM parts),
firsts AS (SELECT part, vendor, product, f, v, min(pos) AS o FROM long WHERE v NOT IN ('*', '-') GROUP BY ALL)
SELECT part, vendor, product, (SELECT 1) * any_value(first_pos) AS first_pos,
  coalesce(string_agg(v, ',' ORDER BY o, v) FILTER (f = 'version'), '') AS versions,
  coalesce(string_agg(v, ',' ORDER BY o, v) FILTER (f = 'update'), '') AS updates,
  coalesce(string_agg(v, ',' ORDER BY o, v) FILTER (f = 'target_sw'), '') AS target_sws
FROM (SELECT part, vendor, product, min(pos) AS first_pos FROM long GROUP BY ALL) LEFT JOIN firsts USING (part, vendor, product) GROUP BY part, vendor, product
""")
def cpe_aggregate(spark, folder):
    out = cpe.aggregate_uris(uris(spark, folder), "uri", pos="pos")
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("part", "vendor", "product", "first_pos", join("versions"), join("updates"), join("target_sws"))


@query("cpe_labels", f"""
WITH {URIS} SELECT l_orderkey, l_linenumber, CASE p[3] WHEN 'a' THEN 'application' WHEN 'h' THEN 'hardware' WHEN 'o' THEN 'operating system' ELSE p[3] END AS label,
  lower(trim(replace(p[4], '_', ' '))) AS vendor, lower(trim(replace(p[5], '_', ' '))) AS product FROM parts
""")
def cpe_labels(spark, folder):
    uri = F.col("uri")
    return uris(spark, folder).select(
        "l_orderkey", "l_linenumber", cpe.part_label(F.get(F.split(uri, ":"), F.lit(2))).alias("label"),
        cpe.normalise_name(cpe.vendor_of(uri)).alias("vendor"), cpe.normalise_name(cpe.product_of(uri)).alias("product"),
    )


@query("cpe_exact_matches", """
WITH t AS (SELECT doc_id, lower(text) AS text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM documents),
w AS (SELECT *, string_split_regex(text, '[\\p{L}\\p{N}_]+') AS gaps FROM t),
e AS (SELECT doc_id, unnest(words) AS matched, generate_subscripts(words, 1) AS i, words, gaps FROM w)
SELECT doc_id, matched, CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN words[1:i - 1]]), 0) AS INTEGER) AS position,
       CAST(length(matched) AS INTEGER) AS length
FROM e WHERE matched = words[1]
""")
def cpe_exact_matches(spark, folder):
    """Every place of each document's first word."""
    word = F.get(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)), F.lit(0))
    rows = documents(spark, folder).withColumn("word", word).filter(F.col("word").isNotNull())
    return rows.select("doc_id", F.explode(cpe.exact_matches(F.col("text"), F.col("word"))).alias("m")).select("doc_id", "m.*")


_sentence = "'A flaw in ' || s_name || ' ' || split_part(p_name, ' ', 1) || ' ' || p_name || ' ' || l_linenumber || ' lets ' || p_type || ' users of ' || upper(p_name) || ' in'"


def sentences(spark, folder):
    rows = line_items(spark, folder).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "s_name", "p_name", "p_type", F.expr(_sentence).alias("text"), F.expr(_uri).alias("uri"))


_words = "split_part(p_name, ' ', 1) || ' ' || p_name"


@query("cpe_partial_matches", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, s_name, p_name, {_sentence} AS text, s_name || ' ' || {_words} AS spread
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, l_linenumber, 'vendor' AS shape, spread AS matched, CAST(strpos(text, spread) - 1 AS INTEGER) AS position, CAST(length(spread) AS INTEGER) AS length FROM r
UNION ALL SELECT l_orderkey, l_linenumber, 'head', 'flaw in', 2, 7 FROM r
""")
def cpe_partial_matches(spark, folder):
    """The supplier with one word before the product; a vendor's first word before its product."""
    rows = sentences(spark, folder)
    vendor = cpe.partial_matches(F.col("text"), F.col("s_name"), F.col("p_name"))
    head = cpe.partial_matches(F.col("text"), F.lit("flaw maker"), F.lit("in"))
    both = F.concat(F.transform(vendor, lambda m: F.struct(F.lit("vendor").alias("shape"), m.alias("m"))), F.transform(head, lambda m: F.struct(F.lit("head").alias("shape"), m.alias("m"))))
    return rows.select("l_orderkey", "l_linenumber", F.explode(both).alias("x")).select("l_orderkey", "l_linenumber", "x.shape", "x.m.*")


@query("cpe_left_out_matches", """
WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part),
s AS (SELECT p_partkey, ws, 'x ' || array_to_string(list_reverse(ws[2:]), ' ') || ' y ' || array_to_string(ws[2:], ' ') AS text FROM w WHERE len(ws) > 1),
p AS (SELECT p_partkey, ws, text, unnest(range(1, len(ws) + 1)) AS i FROM s),
q AS (SELECT p_partkey, text, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS pat FROM p),
g AS (SELECT p_partkey, i, pat, string_split(' ' || text || ' ', ' ' || pat || ' ') AS gaps FROM q)
SELECT p_partkey, pat AS matched, CAST(length(gaps[1]) AS INTEGER) AS position, CAST(length(pat) AS INTEGER) AS length FROM g WHERE len(gaps) = 2
UNION ALL SELECT p_partkey, pat, CAST(length(gaps[1]) AS INTEGER), CAST(length(pat) AS INTEGER) FROM g WHERE len(gaps) = 3
UNION ALL SELECT p_partkey, pat, CAST(length(gaps[1]) + length(gaps[2]) + length(pat) + 2 AS INTEGER), CAST(length(pat) AS INTEGER) FROM g WHERE len(gaps) = 3
""")
def cpe_left_out_matches(spark, folder):
    """Product names with one word left out, in texts made of their other words."""
    words = F.split("p_name", " ")
    rest = F.slice(words, 2, F.size(words))
    text = F.concat(F.lit("x "), F.array_join(F.reverse(rest), " "), F.lit(" y "), F.array_join(rest, " "))
    rows = table(spark, folder, "part").filter(F.size(words) > 1).withColumn("text", text)
    return rows.select("p_partkey", F.explode(cpe.partial_matches(F.col("text"), F.lit(""), F.col("p_name"))).alias("m")).select("p_partkey", "m.*")


def sql_common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two SQL strings of up to 62 letters: a row of bits per letter, reduced over a list."""
    full = f"((1::BIGINT << length({a})) - 1)"
    hits = f"[CAST(list_sum([CASE WHEN substring({a}, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0 END FOR i IN range(1, length({a}) + 1)]) AS BIGINT) FOR c IN string_split({b}, '')]"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {hits}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def sql_ratio(a: str, b: str) -> str:
    """Indel similarity 0..100, rounded half to even; 0 where the lengths alone keep it from 71."""
    total = f"(length({a}) + length({b}))"
    return f"(CASE WHEN 200 * least(length({a}), length({b})) <= 70 * {total} THEN 0 ELSE CAST(round_even(200.0::DOUBLE * {sql_common(a, b)} / {total}, 0) AS INTEGER) END)"


@query("cpe_fuzzy_terms", f"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) GROUP BY word),
t AS (SELECT DISTINCT lower(unnest(list_concat(string_split(p_name, ' '), [p_name, p_type]))) AS term FROM part),
r AS (SELECT term, word, n, {sql_ratio("word", "term")} AS score FROM w, t WHERE 200 * least(length(word), length(term)) > 70 * (length(word) + length(term)))
SELECT term, word, score, n FROM r WHERE score > 70
""")
def cpe_fuzzy_terms(spark, folder):
    """Words of the documents like words, names and types of the products."""
    words = table(spark, folder, "part").select(F.explode(F.concat(F.split("p_name", " "), F.array("p_name", "p_type"))).alias("word"))
    return cpe.fuzzy_terms(documents(spark, folder), "doc_id", "text", words, "word")


_terms = "list_distinct(list_concat(string_split(p_name, ' '), [p_name, s_name, p_type]))"


@query("cpe_fuzzy_matches", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {_terms} AS terms, {_sentence} AS text FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
w AS (SELECT *, regexp_extract_all(text, '\\w+') AS words, string_split_regex(text, '\\w+') AS gaps FROM r),
x AS (SELECT l_orderkey, l_linenumber, terms, words, gaps, unnest(range(1, len(words) + 1)) AS i FROM w),
e AS (SELECT l_orderkey, l_linenumber, words[i] AS matched, CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(y) FOR y IN words[1:i - 1]]), 0) AS INTEGER) AS position, unnest(terms) AS term FROM x),
d AS (SELECT DISTINCT lower(matched) AS word, lower(term) AS term FROM e),
c AS (SELECT word, term FROM d WHERE {sql_ratio("word", "term")} > 70)
SELECT l_orderkey, l_linenumber, e.term, matched, position, CAST(length(matched) AS INTEGER) AS length FROM e JOIN c ON lower(e.matched) = c.word AND lower(e.term) = c.term
""")
def cpe_fuzzy_matches(spark, folder):
    """Words like the supplier, the type, the product's name or any word of it."""
    terms = F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_name", "s_name", "p_type")))
    rows = sentences(spark, folder).select("l_orderkey", "l_linenumber", "text", terms.alias("terms"))
    found = F.explode(cpe.fuzzy_matches_each(F.col("text"), F.col("terms")))
    return rows.select("l_orderkey", "l_linenumber", found.alias("m")).select("l_orderkey", "l_linenumber", "m.*")


@query("cpe_fuzzy_spans", f"""
WITH r AS (SELECT p_partkey, lower(p_name) AS term, p_type || ' ' || p_name || ' of ' || p_brand AS text FROM part),
w AS (SELECT *, regexp_extract_all(text, '\\w+') AS words, string_split_regex(text, '\\w+') AS gaps FROM r),
p AS (SELECT *, [CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(y) FOR y IN words[1:i - 1]]), 0) AS INTEGER) FOR i IN range(1, len(words) + 1)] AS places FROM w),
i AS (SELECT p_partkey, term, text, words, places, unnest(range(1, len(words) + 1)) AS i FROM p),
s AS (SELECT p_partkey, term, text, places[i] AS position, unnest([places[j] + length(words[j]) - places[i] FOR j IN range(i, len(words) + 1)]) AS length FROM i),
k AS (SELECT DISTINCT term, lower(substring(text, CAST(position + 1 AS BIGINT), CAST(length AS BIGINT))) AS run FROM s),
v AS (SELECT term, run, CASE WHEN length(run) < length(term) THEN run ELSE term END AS short, CASE WHEN length(run) < length(term) THEN term ELSE run END AS long FROM k),
o AS (SELECT term, run, short, unnest([substring(long, i, length(short)) FOR i IN range(1, length(long) - length(short) + 2)]) AS piece FROM v),
q AS (SELECT short, piece, {sql_ratio("short", "piece")} AS score FROM (SELECT DISTINCT short, piece FROM o)),
m AS (SELECT term, run FROM o JOIN q USING (short, piece) GROUP BY term, run HAVING max(score) > 70),
f AS (SELECT DISTINCT s.p_partkey, s.term, s.text, s.position, s.length FROM s JOIN m ON m.term = s.term AND m.run = lower(substring(s.text, CAST(s.position + 1 AS BIGINT), CAST(s.length AS BIGINT)))),
b AS (SELECT *, length >= length(term) AS open, row_number() OVER (PARTITION BY p_partkey, position, length >= length(term) ORDER BY length) AS n FROM f)
SELECT p_partkey, substring(text, CAST(position + 1 AS BIGINT), CAST(length AS BIGINT)) AS matched, CAST(position AS INTEGER) AS position, CAST(length AS INTEGER) AS length, open FROM b WHERE NOT open OR n = 1
""")
def cpe_fuzzy_spans(spark, folder):
    """Runs like the product's name in its description, whatever their length."""
    parts = spread(table(spark, folder, "part"), "p_partkey")
    rows = parts.withColumn("text", F.concat("p_type", F.lit(" "), "p_name", F.lit(" of "), "p_brand"))
    found = F.explode(cpe.fuzzy_span_matches(F.col("text"), F.col("p_name")))
    return rows.select("p_partkey", found.alias("m")).select("p_partkey", "m.*")


@query("cpe_split_words", """
SELECT p_partkey, 'a ' || 'X' || ' b ' || split_part(p_name, ' ', 1) AS text FROM part
""")
def cpe_split_words(spark, folder):
    """A name broken after its first letter is found; the whole name is left."""
    rows = table(spark, folder, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(1)))
    broken = F.concat(F.lit("a "), F.substring("word", 1, 1), F.lit("  "), F.expr("substring(word, 2)"), F.lit(" b "), "word")
    return rows.select("p_partkey", cpe.replace_split_word(broken, F.col("word"), "X").alias("text"))


def _sql_sub(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {pattern}, {new}, 'g')"


def _sql_near(text: str, term: str) -> str:
    """The words of a text that are like a term, replaced by the label."""
    close = f"list_filter(list_distinct(regexp_extract_all({text}, '\\w+')), lambda w: {sql_ratio('w', term)} > 70)"
    return f"(CASE WHEN len({close}) = 0 THEN {text} ELSE " + _sql_sub(text, f"'\\b(?:' || array_to_string({close}, '|') || ')\\b'", "label") + " END)"


@query("cpe_mask_products", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, lower(trim({_sentence})) AS t, lower(trim(replace(s_name, '#', ' '))) AS v, lower(p_name) AS p, lower(p_type) AS target,
    CASE l_returnflag WHEN 'A' THEN 'application' WHEN 'N' THEN 'hardware' WHEN 'R' THEN 'operating system' END AS label,
    CAST(l_linenumber AS VARCHAR) AS version, CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'sp' || l_linenumber END AS patch
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
a AS (SELECT * REPLACE ({_sql_sub("t", "'\\b' || v || ' ' || p || '\\b'", "label")} AS t) FROM r),
b AS (SELECT * REPLACE ({_sql_sub("t", "'\\b' || split_part(v, ' ', 1) || '\\b\\s+' || p", "label")} AS t) FROM a),
c AS (SELECT * REPLACE ({_sql_sub("t", "'\\b' || v || '\\b\\s+(?:\\w+\\s+){0,2}' || p", "label")} AS t) FROM b),
d AS (SELECT * REPLACE ({_sql_near("t", "(v || ' ' || p)")} AS t) FROM c),
e AS (SELECT * REPLACE ({_sql_sub("t", "'\\b' || p || '\\b'", "label")} AS t) FROM d),
f AS (SELECT * REPLACE ({_sql_near("t", "p")} AS t) FROM e),
g AS (SELECT *, string_split(p, ' ') AS ws FROM f),
h AS (SELECT * REPLACE (CASE WHEN len(ws) = 1 THEN t ELSE list_reduce(
    list_prepend(t, ['\\b(?:' || array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), '\\s+') || ')\\b' FOR i IN range(1, len(ws) + 1)]),
    lambda x, y: regexp_replace(x, y, label, 'g')) END AS t) FROM g),
k AS (SELECT * REPLACE (replace(replace(replace(t, target, 'software'), version, ''), coalesce(patch, '~'), '') AS t) FROM h),
l AS (SELECT * REPLACE (CASE WHEN regexp_matches(t, '\\b' || v || '\\b') THEN {_sql_sub("t", "'\\b' || v || '\\b'", "''")} ELSE t END AS t) FROM k),
m AS (SELECT * REPLACE (trim({_sql_sub("t", "'\\s+'", "' '")}) AS t) FROM l)
SELECT l_orderkey, l_linenumber, trim({_sql_sub(_sql_sub("t", "'(\\b' || label || '\\b)(?:[\\s,.;:]*' || label || ')+'", "label"), "'\\s+'", "' '")}) AS text FROM m
""")
def cpe_mask_products(spark, folder):
    rows = sentences(spark, folder)
    return rows.select("l_orderkey", "l_linenumber", cpe.mask_products(F.col("text"), F.array("uri")).alias("text"))
