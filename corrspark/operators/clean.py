"""The ordered cleaning pipeline and the cumulative text versions."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrspark import lexicon
from corrspark.functions import text as T
from corrspark.functions import words as W
from corrspark.functions.pieces import map_pieces
from corrspark.operators.blocks import BROADCAST_LIMIT, ROW, measured_size, numbered, text_bytes

# Word repeats and file paths (patterns of the Python regex engine).
REPEATS = re.compile(r"(?i)\b(\w+)\b[\s,.;:]*\1+")
ANY_PATH = r"(?:[A-Za-z]:)?[\\/][\w.-]+(?:[\\/][\w.-]+)*"


@dataclass(frozen=True)
class CleanOptions:
    """Flags of the pipeline with the defaults of direct use."""

    remove_puncts: bool = True
    lowercase: bool = True
    remove_space_newline: bool = True
    genitive: bool = True
    remove_versions: bool = False
    remove_products: bool = False
    remove_entities: bool = False
    remove_dates: bool = False
    remove_links: bool = True
    expand_contractions: bool = False
    sentence_tokenization: bool = False
    lemmatize: bool = False
    remove_file_paths: bool = False
    remove_special_characters: bool = False
    replace_file_paths: bool = False
    advanced_tokenization: bool = False
    remove_stop_words: bool = False
    remove_file_names: bool = False
    remove_digits: bool = False
    remove_parentheses_content: bool = False
    remove_punctuation: bool = True
    preserve_file_extensions: bool = True
    remove_consecutive_repeat: bool = False


# What a correlation request switches on when it says nothing.
SERVICE_DEFAULTS = CleanOptions(genitive=False, remove_versions=True, remove_links=False, remove_punctuation=False)
# Spellings that request forms use for two of the flags.
FLAG_SPELLINGS = {"remove_stopwords": "remove_stop_words", "lemmatization": "lemmatize"}


def service_options(flags: dict[str, bool] | None = None) -> CleanOptions:
    """Options of a request; every flag is honoured, both spellings are accepted."""
    known = {f.name for f in fields(CleanOptions)}
    named = {FLAG_SPELLINGS.get(k, k): bool(v) for k, v in (flags or {}).items()}
    unknown = sorted(set(named) - known)
    if unknown:
        raise ValueError(f"unknown cleaning options: {unknown}")
    return replace(SERVICE_DEFAULTS, **named)


def _rewrite(col: Column, rule) -> Column:
    """Apply a string rule inside Arrow batches, piece by piece; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return map_pieces(texts, rule, pa.string())

    return run(col)


def remove_consecutive_repeats(col: Column) -> Column:
    """Collapse repeated words until nothing changes (needs a loop per text)."""

    def rule(text: str) -> str:
        before = None
        while before != text:
            before, text = text, REPEATS.sub(r"\1", text)
        return text

    return _rewrite(col, rule)


def replace_file_paths(col: Column) -> Column:
    """A path becomes "<extension> file", or "file" when it has none."""

    def name(path: Column) -> Column:
        return F.when(F.contains(path, F.lit(".")), F.concat(F.substring_index(path, ".", -1), F.lit(" file"))).otherwise("file")

    return T.collapse_all(T.replace_each(col, ANY_PATH, name))


def lemmatize_text(col: Column, lemma=W.noun_lemma) -> Column:
    """Tokens replaced by their lemmas, joined by one space."""
    return _rewrite(col, lambda text: " ".join(lemma(t) for t in W.tokens(text)))


def stem_text(col: Column, stem=W.stem) -> Column:
    return _rewrite(col, lambda text: " ".join(stem(t) for t in W.tokens(text)))


def lemmatize_with_lexicon(
    df: DataFrame, key: str, col: str, out: str, table: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Lemmas from a (token, lemma) table; tokens it does not list stay.

    A token listed twice takes its smallest lemma; one without a lemma stays. A
    table below the limit is broadcast and looked up in place. A larger one is
    joined on the distinct tokens of slices of the texts, so a word that all texts
    share comes once per slice. Both ways see the same tokens.
    """
    listed = table.filter(F.col("token").isNotNull()).groupBy("token").agg(F.min("lemma").alias("lemma")).filter(F.col("lemma").isNotNull())
    token = F.regexp_extract_all(F.col(col), F.lit(r"(?U)\w+(?:[.\-]\w+)*|[^\w\s]"), F.lit(0))
    if measured_size(listed, text_bytes(F.col("token"), F.col("lemma"))) <= limit:
        pairs = listed.toArrow().to_pydict()
        shared = df.sparkSession.sparkContext.broadcast(dict(zip(pairs["token"], pairs["lemma"])))

        @F.arrow_udf("string")
        def lookup(tokens: pa.Array) -> pa.Array:
            lemma = shared.value
            return map_pieces(tokens, lambda words: " ".join(lemma.get(w, w) for w in words), pa.string())

        return df.withColumn(out, lookup(token))
    rows = numbered(df.withColumn("_tokens", token))
    tokens = rows.select(ROW, F.posexplode("_tokens").alias("pos", "token")).withColumn("_slice", F.floor(F.col(ROW) / 1024))
    found = tokens.select("_slice", "token").distinct().join(listed, "token")
    lemmas = tokens.join(found, ["_slice", "token"], "left")
    entry = F.struct("pos", F.coalesce("lemma", "token").alias("lemma"))
    texts = lemmas.groupBy(ROW).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    joined = texts.select(ROW, F.array_join(F.transform("t", lambda e: e["lemma"]), " ").alias("_out"))
    whole = rows.join(joined, ROW, "left").withColumn(out, F.when(F.col(col).isNotNull(), F.coalesce("_out", F.lit(""))))
    return whole.select(*[c for c in df.columns if c != out], out)


def clean_column(
    col: Column,
    options: CleanOptions = CleanOptions(),
    stopwords=lexicon.STOPWORDS,
    lemma=W.noun_lemma,
    cpes: Column | None = None,
) -> Column:
    """All steps of the pipeline, in their fixed order."""
    from corrspark.operators.cpe import mask_products

    o = options
    steps = [
        (o.remove_puncts, T.remove_puncts),
        (o.lowercase, T.lowercase),
        (o.remove_space_newline, T.remove_space_newline),
        (o.genitive, T.genitive),
        (o.remove_versions, T.remove_versions),
        (o.remove_products and cpes is not None, lambda c: mask_products(c, cpes)),
        (o.remove_entities, T.remove_entities),
        (o.remove_dates, T.remove_dates),
        (o.remove_links, T.remove_links),
        (o.expand_contractions, T.expand_contractions),
        (o.sentence_tokenization, T.sentence_tokenization),
        (o.lemmatize, lambda c: lemmatize_text(c, lemma)),
        (o.remove_file_paths, T.remove_file_paths),
        (o.remove_special_characters, T.remove_special_characters),
        (o.replace_file_paths, replace_file_paths),
        (o.advanced_tokenization, T.advanced_tokenization),
        (o.remove_stop_words, lambda c: T.remove_stop_words(c, stopwords)),
        (o.remove_file_names, T.remove_file_names),
        (o.remove_digits, T.remove_digits),
        (o.remove_parentheses_content, T.remove_parentheses_content),
        (o.remove_punctuation, lambda c: T.remove_punctuation(c, o.preserve_file_extensions)),
        (o.remove_consecutive_repeat, remove_consecutive_repeats),
        (o.remove_space_newline, T.remove_space_newline),
        (o.remove_puncts, T.remove_puncts),
    ]
    for wanted, step in steps:
        if wanted:
            col = step(col)
    return col


def clean_text(df: DataFrame, in_col: str, out_col: str, options: CleanOptions = CleanOptions(), **lexicons) -> DataFrame:
    return df.withColumn(out_col, clean_column(F.col(in_col), options, **lexicons))


def clean_requested(requests: DataFrame, cves: DataFrame, options: CleanOptions = SERVICE_DEFAULTS, **lexicons) -> DataFrame:
    """(cve_id, text, error) of the requested ids.

    An unknown id or a blank description is an error row, not a failed job.
    """
    wanted = requests.select("cve_id").distinct()
    texts = cves.select(F.col("id").alias("cve_id"), "description", F.lit(True).alias("_known"))
    rows = wanted.join(texts, "cve_id", "left")
    error = F.when(F.col("_known").isNull(), "not found").when(
        F.coalesce(T.strip(F.col("description")), F.lit("")) == "", "no valid description"
    )
    cleaned = clean_column(F.col("description"), options, **lexicons)
    return rows.select("cve_id", F.when(error.isNull(), cleaned).alias("text"), error.alias("error"))


# --- cumulative versions ---------------------------------------------------

TEXT_FIELDS = ("name", "description", "extended_description")
LIST_FIELDS = (
    "indicators", "prerequisites", "resources_required", "mitigations", "example_instances",
    "consequences", "skills_required", "alternate_terms",
)


def _list_rule(col: Column, rule) -> Column:
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return map_pieces(lists, lambda items: [rule(x) for x in items], pa.list_(pa.string()))

    return run(col)


def _version_steps(stopwords, lemma, stem):
    lemma_rule = lambda s: " ".join(lemma(t) for t in W.tokens(s))
    stem_rule = lambda s: " ".join(stem(t) for t in W.tokens(s))
    stop = lambda c: T.remove_stop_words(c, stopwords)
    return [
        (stop, lambda c: F.transform(c, stop)),
        (lambda c: _rewrite(c, lemma_rule), lambda c: _list_rule(c, lemma_rule)),
        (lambda c: _rewrite(c, stem_rule), lambda c: _list_rule(c, stem_rule)),
    ]


def cumulative_versions(
    basic: DataFrame,
    texts: tuple[str, ...],
    lists: tuple[str, ...] = (),
    stopwords=lexicon.STOPWORDS,
    lemma=W.noun_lemma,
    stem=W.stem,
) -> DataFrame:
    """The four versions of cleaned columns, one row each.

    Every version is worked out once from the one before; all four leave one
    pass over the input.
    """
    keep = [c for c in basic.columns if c not in (*texts, *lists)]
    versions = [F.struct(*texts, *lists)]
    rows = basic.select(*keep, versions[0].alias("v0"))
    for i, (on_text, on_list) in enumerate(_version_steps(stopwords, lemma, stem)):
        before = F.col(f"v{i}")
        stage = [on_text(before[c]).alias(c) for c in texts] + [on_list(before[c]).alias(c) for c in lists]
        rows = rows.withColumn(f"v{i + 1}", F.struct(*stage))
    labelled = [
        F.struct(F.lit(name).alias("preprocessed_version"), F.col(f"v{i}").alias("v"))
        for i, name in enumerate(lexicon.TEXT_VERSIONS)
    ]
    out = rows.select(*keep, F.explode(F.array(*labelled)).alias("e"))
    return out.select(*keep, "e.preprocessed_version", *[F.col(f"e.v.{c}").alias(c) for c in (*texts, *lists)])


def basic_patterns(patterns: DataFrame) -> DataFrame:
    """Aggregation-cleaned fields of raw patterns."""
    cleaned = {name: T.clean_for_aggregation(F.col(name)) for name in TEXT_FIELDS}
    cleaned |= {name: T.clean_list(F.col(name)) for name in LIST_FIELDS if name not in ("consequences", "skills_required")}
    nothing = F.array().cast("array<string>")
    cleaned["consequences"] = F.coalesce(T.clean_consequences(F.col("consequences")), nothing)
    cleaned["skills_required"] = F.coalesce(T.clean_skills(F.col("skills_required")), nothing)
    return patterns.select("id", "status", *[cleaned[c].alias(c) for c in (*TEXT_FIELDS, *LIST_FIELDS)])


def aggregate_patterns(patterns: DataFrame) -> DataFrame:
    """Add ``*_aggregated`` strings and the overall text of string-list patterns."""
    joined = {f"{c}_aggregated": F.coalesce(c, F.lit("")) for c in ("description", "extended_description")}
    joined |= {f"{c}_aggregated": T.join_list(F.col(c)) for c in LIST_FIELDS}
    rows = patterns.withColumns(joined)
    return rows.withColumn("overall_aggregated_text", T.join_fields(*[F.col(c) for c in joined]))


def aggregate_raw_patterns(patterns: DataFrame) -> DataFrame:
    """Aggregates of raw patterns; the overall text joins the seven plain fields.

    Consequences and skills are structs here and are spelled out for their
    aggregates.
    """
    spelled = patterns.withColumn("_c", T.clean_consequences(F.col("consequences"))).withColumn("_s", T.clean_skills(F.col("skills_required")))
    plain = ("indicators", "prerequisites", "resources_required", "mitigations", "example_instances")
    joined = {f"{c}_aggregated": F.coalesce(c, F.lit("")) for c in ("description", "extended_description")}
    joined |= {f"{c}_aggregated": T.join_list(F.col(c)) for c in plain}
    rows = spelled.withColumns(joined).withColumn("overall_aggregated_text", T.join_fields(*[F.col(c) for c in joined]))
    extra = {"consequences": "_c", "skills_required": "_s", "alternate_terms": "alternate_terms"}
    return rows.withColumns({f"{c}_aggregated": T.join_list(F.col(src)) for c, src in extra.items()}).drop("_c", "_s")


def pattern_versions(patterns: DataFrame, **lexicons) -> DataFrame:
    """Preprocessed patterns: four rows per pattern, aggregates filled."""
    return aggregate_patterns(cumulative_versions(basic_patterns(patterns), TEXT_FIELDS, LIST_FIELDS, **lexicons))


def aggregate_steps(steps: DataFrame) -> DataFrame:
    return steps.withColumns({
        "description_aggregated": F.coalesce("description", F.lit("")),
        "techniques_aggregated": T.join_list(F.col("techniques")),
    })


def step_versions(steps: DataFrame, **lexicons) -> DataFrame:
    """Preprocessed attack steps: four rows per step, keyed by the step (not its text)."""
    basic = steps.select(
        "capec_id", "pos", "step", "phase",
        T.clean_for_aggregation(F.col("description")).alias("description"),
        T.clean_list(F.col("techniques")).alias("techniques"),
    )
    return aggregate_steps(cumulative_versions(basic, ("description",), ("techniques",), **lexicons))
