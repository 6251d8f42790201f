"""Cleaning steps and text versions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark.functions import text as T
from corrspark.functions import words as W
from corrspark.operators import clean, dictionary
from corrspark.session import scratch_dir
from corrspark.sources import buckets
from registry import sql_text as S
from registry import stem_sql as ST
from registry.base import documents, query, table


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", "text")


def register_step(name: str, step, sql) -> None:
    """A cleaning step over documents."""

    @query(name, f"SELECT doc_id, {sql('text')} AS text FROM documents")
    def run(spark, folder):
        return docs(spark, folder).select("doc_id", step(F.col("text")).alias("text"))


for _name, _step, _sql in (
    ("clean_lowercase", T.lowercase, lambda x: f"lower({x})"),
    ("clean_puncts", T.remove_puncts, S.puncts),
    ("clean_space_newline", T.remove_space_newline, S.space),
    ("clean_digits", T.remove_digits, S.digits),
    ("clean_punctuation", T.remove_punctuation, S.punctuation),
    ("clean_punctuation_all", lambda c: T.remove_punctuation(c, False), lambda x: S.punctuation(x, False)),
    ("clean_parentheses", T.remove_parentheses_content, S.parentheses),
    ("clean_special_characters", T.remove_special_characters, S.special),
    ("clean_stop_words", T.remove_stop_words, S.stop_words),
    ("clean_sentences", T.sentence_tokenization, S.sentences),
    ("clean_tokens", T.advanced_tokenization, S.tokens),
    ("clean_aggregate", T.clean_for_aggregation, S.aggregation),
    ("clean_versions", lambda c: T.remove_versions(F.lower(c)), lambda x: S.versions(f"lower({x})")),
    ("clean_service_pipeline", lambda c: clean.clean_column(c, clean.SERVICE_DEFAULTS), S.service),
    ("uniform_string", T.uniform_string, S.uniform),
    ("summary_text", lambda c: _summary(c), lambda x: f"CASE WHEN length({x}) > 100 THEN substring({x}, 1, 100) || '...' ELSE {x} END"),
    ("parentheses_content", T.first_parentheses,
     lambda x: f"CASE WHEN regexp_matches({x}, '\\((.*?)\\)') THEN regexp_extract({x}, '\\((.*?)\\)', 1) ELSE {x} END"),
    ("parentheses_stripped", T.strip_parentheses, lambda x: S.blanks(S.sub(x, r"\(.*?\)"))),
):
    register_step(_name, _step, _sql)


def _summary(col: Column) -> Column:
    from corrspark.functions.records import summary

    return summary(col)


FULL = clean.CleanOptions(
    remove_versions=True, remove_entities=True, sentence_tokenization=True, advanced_tokenization=True,
    remove_stop_words=True, remove_digits=True, remove_parentheses_content=True,
)
_full = "text"
for _sql in (S.puncts, lambda x: f"lower({x})", S.space, S.genitive, S.versions, S.entities, S.links, S.sentences,
             S.tokens, S.stop_words, S.digits, S.parentheses, S.punctuation, S.space, S.puncts):
    _full = _sql(_full)


@query("clean_full_pipeline", f"SELECT doc_id, {_full} AS text FROM documents")
def clean_full_pipeline(spark, folder):
    return clean.clean_text(docs(spark, folder), "text", "text", FULL)


@query("clean_links", f"SELECT page_id, {S.links(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + ' for ' + chr(39) + ' || html')} AS text FROM pages")
def clean_links(spark, folder):
    text = F.concat(F.lit("see "), "url", F.lit(" for "), "html")
    return table(spark, folder, "pages").select("page_id", T.remove_links(text).alias("text"))


@query("clean_file_paths", f"SELECT page_id, {S.paths('url')} AS text FROM pages")
def clean_file_paths(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.remove_file_paths(F.col("url")).alias("text"))


@query("clean_replace_paths", f"""
WITH m AS (SELECT page_id, url, regexp_extract(url, {S.quote(S.PATH)}) AS p FROM pages)
SELECT page_id, {S.blanks("replace(url, p, CASE WHEN contains(p, '.') THEN string_split(p, '.')[-1] || ' file' ELSE 'file' END)")} AS text FROM m
""")
def clean_replace_paths(spark, folder):
    return table(spark, folder, "pages").select("page_id", clean.replace_file_paths(F.col("url")).alias("text"))


@query("clean_dates", f"""
SELECT o_orderkey, {S.dates("'Due ' || strftime(o_orderdate, '%Y-%m-%d') || ' or ' || strftime(o_orderdate, '%-d/%-m/%Y') || ' in ' || strftime(o_orderdate, '%B') || ' as ' || o_orderpriority")} AS text FROM orders
""")
def clean_dates(spark, folder):
    day = F.col("o_orderdate")
    text = F.concat(
        F.lit("Due "), F.date_format(day, "yyyy-MM-dd"), F.lit(" or "), F.date_format(day, "d/M/yyyy"),
        F.lit(" in "), F.date_format(day, "MMMM"), F.lit(" as "), "o_orderpriority",
    )
    return table(spark, folder, "orders").select("o_orderkey", T.remove_dates(text).alias("text"))


_contracted = "lower(text)"
_expanded = _contracted
for _word, _short, _long in ((" the ", " it's ", " it is "), (" and ", " don't ", " do not "), (" of ", " we'll ", " we will "), (" in ", " can't ", " cannot ")):
    _contracted = f"replace({_contracted}, {S.quote(_word)}, {S.quote(_short)})"
_expanded = _contracted
for _short, _long in ((" it's ", " it is "), (" don't ", " do not "), (" we'll ", " we will "), (" can't ", " cannot ")):
    _expanded = f"replace({_expanded}, {S.quote(_short)}, {S.quote(_long)})"


@query("clean_contractions", f"SELECT doc_id, {S.runs(_expanded)} AS text FROM documents")
def clean_contractions(spark, folder):
    return docs(spark, folder).select("doc_id", T.expand_contractions(F.expr(_contracted.replace("''", "\\'"))).alias("text"))


_owned = "replace(replace(text, ' of ', '''s '), ' in ', ''' ')"


@query("clean_genitive", f"SELECT doc_id, {S.genitive(_owned)} AS text FROM documents")
def clean_genitive(spark, folder):
    owned = F.replace(F.replace(F.col("text"), F.lit(" of "), F.lit("'s ")), F.lit(" in "), F.lit("' "))
    return docs(spark, folder).select("doc_id", T.genitive(owned).alias("text"))


_phrase = (
    "p_name || ' before ' || p_size || '.' || p_partkey || ', version ' || p_size || '.' || p_size || '.x and sp' || p_size "
    "|| ' fixed in 1.2.' || p_size || ' and earlier, build ' || p_partkey || ' (v' || p_size || ')'"
)


@query("clean_version_phrases", f"SELECT p_partkey, {S.versions(_phrase)} AS text FROM part")
def clean_version_phrases(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.remove_versions(F.expr(_phrase)).alias("text"))


_mention = (
    "'See CVE-' || year(o_orderdate) || '-' || (1000 + o_custkey) || ' or cwe-' || o_custkey || ' and CAPEC-' || o_custkey || ': ' || o_orderpriority"
)


@query("clean_entities", f"SELECT o_orderkey, {S.entities(_mention)} AS text FROM orders")
def clean_entities(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", T.remove_entities(F.expr(_mention)).alias("text"))


_files = "'open ' || replace(p_name, ' ', '_') || '.exe and ' || p_type || '.txt or ' || p_brand || '.md now'"


@query("clean_file_names", f"SELECT p_partkey, {S.file_names(_files)} AS text FROM part")
def clean_file_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.remove_file_names(F.expr(_files)).alias("text"))


@query("clean_repeats")
def clean_repeats(spark, folder):
    return docs(spark, folder).select("doc_id", clean.remove_consecutive_repeats(F.col("text")).alias("text"))


_irregular = " ".join(f"WHEN {S.quote(a)} THEN {S.quote(b)}" for a, b in W.IRREGULAR_NOUNS.items())
_suffixes = " ".join(
    f"WHEN ends_with(t, {S.quote(a)}) AND length(t) > {len(a) + 1} THEN left(t, length(t) - {len(a)}) || {S.quote(b)}" for a, b in W.NOUN_RULES)
_lemma = f"""CASE t {_irregular} ELSE CASE
  WHEN length(t) <= 3 OR ends_with(t, 'ss') OR ends_with(t, 'us') OR ends_with(t, 'is') THEN t {_suffixes}
  WHEN ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END END"""


@query("clean_lemmas", f"SELECT doc_id, array_to_string([{_lemma} FOR t IN regexp_extract_all(text, {S.quote(S.TOKEN)})], ' ') AS text FROM documents")
def clean_lemmas(spark, folder):
    return docs(spark, folder).select("doc_id", clean.lemmatize_text(F.col("text")).alias("text"))


def _rewritten(texts: str, name: str, form: str) -> str:
    """CTE ``name(id, text)``: the tokens of a text table replaced by a form from ``stems``."""
    return f"""{name} AS (SELECT x.id, coalesce(y.text, '') AS text FROM {texts} x LEFT JOIN (
  SELECT id, string_agg({form}, ' ' ORDER BY i) AS text FROM {texts}_t JOIN stems USING (t) GROUP BY id) y USING (id))"""


def _tokens(texts: str) -> str:
    return f"""{texts}_t AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
  FROM (SELECT id, regexp_extract_all(text, {S.quote(S.TOKEN)}) AS ts FROM {texts}))"""


@query("clean_stems", f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
{_tokens('d')},
{ST.stems('d_t')},
{_rewritten('d', 'r', 'stem')}
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN r.text END AS text FROM d JOIN r USING (id)
""")
def clean_stems(spark, folder):
    return docs(spark, folder).select("doc_id", clean.stem_text(F.col("text")).alias("text"))


_WORDS = f"""
WITH d AS (SELECT unnest(regexp_extract_all(text, {S.quote(S.TOKEN)})) AS t FROM documents),
n AS (SELECT t, count(*) AS n, {_lemma} AS lemma FROM d GROUP BY t),
l AS (SELECT lemma AS t FROM n),
{ST.stems('l')}
SELECT n.t AS token, n, lemma, stem FROM n JOIN stems ON stems.t = lemma
"""


@query("word_dictionary", _WORDS)
def word_dictionary(spark, folder):
    return dictionary.with_forms(dictionary.count_tokens(docs(spark, folder)))


@query("word_dictionary_batches", _WORDS)
def word_dictionary_batches(spark, folder):
    """The same table kept over two batches, the second of them given twice."""
    root, texts = scratch_dir(spark, "dictionary"), docs(spark, folder)
    dictionary.update(texts.filter("doc_id % 2 = 0"), root, 0)
    for _ in range(2):
        dictionary.update(texts.filter("doc_id % 2 <> 0"), root, 1)
    return buckets.read(spark, root).select("token", "n", "lemma", "stem")


_plural = "CASE WHEN length(t) > 3 AND right(t, 1) = 's' THEN left(t, length(t) - 1) ELSE t END"


@query("clean_lexicon_lemmas", f"""
SELECT doc_id, array_to_string([{_plural} FOR t IN regexp_extract_all(text, {S.quote(S.TOKEN)})], ' ') AS text FROM documents
""")
def clean_lexicon_lemmas(spark, folder):
    """Lemmas from a table: here the distinct words that end in s, without it."""
    texts = docs(spark, folder)
    word = F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+(?:[.\-]\w+)*"), F.lit(0)))
    words = texts.select(word.alias("token")).distinct().filter((F.length("token") > 3) & F.col("token").endswith("s"))
    lexicon = words.withColumn("lemma", F.expr("left(token, length(token) - 1)"))
    return clean.lemmatize_with_lexicon(texts, "doc_id", "text", "lemmas", lexicon).select("doc_id", F.col("lemmas").alias("text"))


def _versioned(spark, folder, **lexicons):
    basic = docs(spark, folder).select("doc_id", T.clean_for_aggregation(F.col("text")).alias("text"))
    return clean.cumulative_versions(basic, ("text",), **lexicons)


@query("text_versions", f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {S.aggregation('text')} AS basic FROM documents),
k AS (SELECT id, {S.stop_words('basic')} AS text FROM d),
l AS (SELECT id, array_to_string([{_lemma} FOR t IN regexp_extract_all(text, {S.quote(S.TOKEN)})], ' ') AS text FROM k),
{_tokens('l')},
{ST.stems('l_t')},
{_rewritten('l', 'r', 'stem')}
SELECT doc_id, 'Basic' AS preprocessed_version, basic AS text FROM d
UNION ALL SELECT doc_id, 'Stopwords', k.text FROM d JOIN k USING (id)
UNION ALL SELECT doc_id, 'Lemmatization', l.text FROM d JOIN l USING (id)
UNION ALL SELECT doc_id, 'Stemming', r.text FROM d JOIN r USING (id)
""")
def text_versions(spark, folder):
    return _versioned(spark, folder)


@query("text_versions_plain", f"""
WITH b AS (SELECT doc_id, {S.aggregation('text')} AS basic FROM documents),
s AS (SELECT doc_id, basic, {S.stop_words('basic')} AS kept FROM b)
SELECT doc_id, 'Basic' AS preprocessed_version, basic AS text FROM s
UNION ALL SELECT doc_id, v, kept FROM s, (VALUES ('Stopwords'), ('Lemmatization'), ('Stemming')) t(v)
""")
def text_versions_plain(spark, folder):
    """The four versions under lexicons that leave words alone."""
    same = lambda word: word
    return _versioned(spark, folder, lemma=same, stem=same)


@query("clean_list_items", f"""
SELECT doc_id, array_to_string([{S.aggregation('x')} FOR x IN string_split(text, chr(10)) IF x <> ''], '|') AS items FROM documents
""")
def clean_list_items(spark, folder):
    items = T.clean_list(F.split("text", "\n"))
    return docs(spark, folder).select("doc_id", F.array_join(items, "|").alias("items"))


@query("clean_consequences", f"""
SELECT p_partkey, {S.aggregation("'scope ' || p_brand || ' impact ' || p_type || ' ' || p_name || ' note ' || CASE WHEN p_size > 25 THEN p_name ELSE 'None' END")} AS line FROM part
""")
def clean_consequences(spark, folder):
    note = F.when(F.col("p_size") > 25, F.col("p_name"))
    entry = F.struct(F.array("p_brand").alias("Scope"), F.array("p_type", "p_name").alias("Impact"), note.alias("Note"))
    rows = table(spark, folder, "part").select("p_partkey", T.clean_consequences(F.array(entry)).alias("lines"))
    return rows.select("p_partkey", F.array_join("lines", "|").alias("line"))


@query("clean_skills", f"SELECT p_partkey, CASE WHEN p_size > 25 THEN {S.aggregation('p_name')} ELSE '' END AS skills FROM part")
def clean_skills(spark, folder):
    description = F.when(F.col("p_size") > 25, F.col("p_name"))
    entry = F.struct(F.col("p_type").alias("Level"), description.alias("Description"))
    rows = table(spark, folder, "part").select("p_partkey", T.clean_skills(F.array(entry)).alias("skills"))
    return rows.select("p_partkey", F.array_join("skills", "|").alias("skills"))


@query("aggregate_fields", """
SELECT conv_id, turn, role || ' ' || '' || ' ' || array_to_string(string_split(text, chr(10)), ' ') AS text FROM conversations
""")
def aggregate_fields(spark, folder):
    rows = table(spark, folder, "conversations")
    text = T.join_fields(F.col("role"), F.lit(None).cast("string"), T.join_list(F.split("text", "\n")))
    return rows.select("conv_id", "turn", text.alias("text"))


@query("markup_text", f"""
SELECT page_id, nullif({S.blanks(S.sub('html', '</?(?:p|b|i|a|br|li|ul|h1|nav|article)(?: [^>]*)?>'))}, '') AS text FROM pages
""")
def markup_text(spark, folder):
    text = T.inner_text(F.col("html"), "(?:p|b|i|a|br|li|ul|h1|nav|article)(?: [^>]*)?")
    return table(spark, folder, "pages").select("page_id", text.alias("text"))


@query("clean_requested", f"""
SELECT l.doc_id AS cve_id, CASE WHEN d.doc_id IS NOT NULL AND trim(d.text) <> '' THEN {S.service('d.text')} END AS text,
       CASE WHEN d.doc_id IS NULL THEN 'not found' WHEN trim(d.text) = '' THEN 'no valid description' END AS error
FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT o_orderkey FROM orders)) l
LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '' END AS text FROM documents) d USING (doc_id)
""")
def clean_requested(spark, folder):
    """Requests for labelled documents and for ids of which many do not exist."""
    ids = table(spark, folder, "labels").select(F.col("doc_id").alias("cve_id")).unionByName(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("cve_id"))
    )
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise("")
    cves = documents(spark, folder).select(F.col("doc_id").alias("id"), text.alias("description"))
    return clean.clean_requested(ids, cves)
