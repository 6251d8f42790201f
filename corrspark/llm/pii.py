"""Personal data by candidate gradient boosting (operator 12); DataFrame functions only.

Generators with a high recall propose spans that may overlap: the base patterns
(also what their checks drop), mail addresses whose signs are spelled out or set
apart, and chains of digits with and without blanks. A span becomes one candidate
per kind that its digits allow. Candidates have features of their format (digits,
groups, separators, checksum, octets, suffix) and of their context (the characters
beside them, and a cue word before them), but not the sign that opens a base phone
number, so that other spellings of the same thing can be told.

Boosted trees learn from the base spans: a candidate that is one is an example, any
other candidate, also one with other bounds or of another kind, is a counterexample.
They are fitted on the distinct feature rows of a training fold, at most
``SAMPLE_ROWS`` of them in a seeded order, weighted by their counts over all rows.
On the held-out fold (every fifth document by crc32 of its id) each kind gets the
lowest threshold from which at least ``PRECISION`` percent of the candidates are
base spans; a kind that never reaches it adds nothing. A selected candidate becomes
a span if it touches no base span; of several that overlap the one with the best
score stays. Base spans always stay.

Patterns have no nested open repeats, and each run of characters is tried once, so
time is linear in the text whatever it holds.

Edge cases: null and empty texts have no spans; rows that repeat are judged one by
one; a null id is a document of its own; equal scores go by length, place and kind;
a table without examples or without counterexamples has base spans only; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.common import fresh
from corrspark.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Distinct feature rows that the trees are fitted on, at most; trees, their depth and step.
SAMPLE_ROWS, TREES, TREE_DEPTH, STEP = 20_000, 16, 3, 0.3
#: Candidates above a threshold that are base spans, in percent (on the held-out fold), and the least score.
PRECISION, LEAST_SCORE, BINS = 95, 0.5, 100
#: Characters before a span in which a cue is looked for.
CONTEXT = 24

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_AT = r"(?:\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?|\x20@\x20)"
_DOT = r"(?:\.|\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?|\x20dot\x20)"
#: Base patterns, written so that a run of characters is tried from its first one only.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators: spelled addresses, chains of digits with and without blanks.
WIDE = {
    "spelled": rf"(?<!{_LOCAL}){_LOCAL}++(?:@{_LABEL}++|{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)*+|\x20at\x20{_LABEL}++(?:{_DOT}{_LABEL}++)++)",
    "chain": r"\+?+\(?+[0-9](?:[\x20().\-/]{0,2}+[0-9])++",
    "number": r"(?<![0-9])[0-9]++(?:[.\-/][0-9]++)*+",
}
_CUES = {
    "email": "(?i)mail|contact|@", "ip": r"(?i)\bip\b|addr|host|server", "card": "(?i)card|visa|karte|tarjeta|carte",
    "phone": r"(?i)tel|phone|fon|call|mobil|fax",
}
FEATURES = (
    "kind", "n_chars", "n_digits", "n_groups", "first_group", "last_group", "longest_group", "n_blanks", "n_brackets", "n_dots", "n_dashes", "n_letters", "valid", "before", "after", "cue")


class _Found(NamedTuple):
    generator: str
    pattern: str
    asked: Column


def _proposals(text: Column) -> Column:
    """All matches of all generators: generator, number, match, the gap before it, and its surroundings."""
    has_digit = F.rlike(text, F.lit("[0-9]"))
    has_at = F.contains(text, F.lit("@"))
    spelled = has_at | F.rlike(text, F.lit(r"[\[(]\x20?(?:at|dot)\x20?[\])]|\x20dot\x20"))
    sources = [
        *(_Found(k, p, has_at if k == "email" else F.contains(text, F.lit("+")) & has_digit if k == "phone" else has_digit) for k, p in BASE.items()),
        *(_Found(k, p, spelled if k == "spelled" else has_digit) for k, p in WIDE.items()),
    ]

    def matches(source: _Found) -> Column:
        pieces = F.struct(F.regexp_extract_all(text, F.lit(source.pattern), F.lit(0)).alias("m"), F.split(text, source.pattern, -1).alias("p"))
        row = lambda found: F.transform(found["m"], lambda m, i: F.struct(
            F.lit(source.generator).alias("generator"), i.alias("i"), m.alias("match"), F.length(F.get(found["p"], i)).alias("gap"),
            F.right(F.get(found["p"], i), F.lit(CONTEXT)).alias("left"), F.substring(F.get(found["p"], i + 1), 1, 1).alias("right")))
        return F.when(source.asked, F.flatten(F.transform(F.array(pieces), row)))

    return F.concat(*(F.coalesce(matches(s), F.array().cast("array<struct<generator:string,i:int,match:string,gap:int,left:string,right:string>>")) for s in sources))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _octets(match: Column) -> Column:
    def small(part: Column) -> Column:
        own = F.regexp_replace(part, "^0+", "")
        return (F.length(own) <= 3) & (F.coalesce(own.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def _base_valid(generator: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    return (
        F.when(generator == "email", True).when(generator == "ip", _octets(match))
        .when(generator == "card", n.between(16, 19) & F.call_function("luhn_check", _digits(match))).when(generator == "phone", n.between(8, 15)).otherwise(False)
    )


def _kinds(generator: Column, match: Column) -> Column:
    """Kinds a match is a candidate of."""
    n = F.length(_digits(match))
    some = lambda kind, when: F.when(when, F.lit(kind))
    of_number = F.array_compact(F.array(
        some("ip", F.rlike(match, F.lit(r"^[0-9]+(\.[0-9]+){1,5}$"))), some("card", n.between(12, 19)), some("phone", n.between(7, 15))))
    return F.when(generator.isin(*KINDS), F.array(generator)).when(generator == "spelled", F.array(F.lit("email"))).otherwise(of_number)


def _features(kind: Column, match: Column, left: Column, right: Column) -> list[Column]:
    count = lambda pattern: F.length(match) - F.length(F.regexp_replace(match, pattern, ""))
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    digits = _digits(match)
    beside = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"[\p{L}\p{N}_]")), 2).when(F.rlike(c, F.lit(r"\s")), 0).otherwise(1)
    valid = (
        F.when(kind == "email", F.rlike(match, F.lit(r"[.\x20)\]][A-Za-z]{2,24}$"))).when(kind == "ip", (F.size(groups) == 4) & _octets(match))
        .when(kind == "card", F.call_function("luhn_check", digits)).otherwise(F.coalesce(F.element_at(sizes, -1), F.lit(0)) == 4)
    )
    cue = F.coalesce(*(F.when(kind == k, F.rlike(left, F.lit(p))) for k, p in _CUES.items()))
    number = F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)))
    capped = lambda c, most: F.least(F.coalesce(c, F.lit(0)), F.lit(most)).cast("int")
    values = (
        number, capped(F.length(match), 64), capped(F.length(digits), 32), capped(F.size(groups), 16), capped(F.get(sizes, F.lit(0)), 20),
        capped(F.when(F.size(sizes) > 0, F.element_at(sizes, -1)), 20), capped(F.array_max(sizes), 20), capped(count(r"\s"), 8), capped(count(r"[()\[\]]"), 4),
        capped(count(r"\."), 8), capped(count("[-/]"), 8), capped(count("[A-Za-z]"), 32), valid.cast("int"), beside(F.right(left, F.lit(1))), beside(right), cue.cast("int"))
    return [v.cast("int").alias(f"f_{name}") for name, v in zip(FEATURES, values, strict=True)]


_F = [f"f_{name}" for name in FEATURES]


def candidates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end, base, touches, f_...``: every candidate of every document.

    ``row`` numbers the documents; one without candidates has a row with no kind.
    ``touches`` says that some base span overlaps the candidate.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # rows get their numbers before the proposals are taken apart
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    named = numbered.select("row", "doc_id", F.explode_outer(_proposals(F.col("text"))).alias("x"))
    rows = named.select("row", "doc_id", "x.*").repartition("row")
    along = Window.partitionBy("row", "generator").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(along)).withColumn("start", F.col("end") - F.length("match"))
    base = _base_valid(F.col("generator"), F.col("match"))
    kinds = placed.select(
        "row", "doc_id", "start", "end", "match", "left", "right", F.coalesce(base, F.lit(False)).alias("base"),
        F.explode_outer(_kinds(F.col("generator"), F.col("match"))).alias("kind"))
    featured = kinds.select("row", "doc_id", "kind", "start", "end", "base", F.struct(*_features(F.col("kind"), F.col("match"), F.col("left"), F.col("right"))).alias("f"))
    single = featured.groupBy("row", "doc_id", "kind", "start", "end").agg(F.max("base").alias("base"), F.min("f").alias("f"))
    # base spans that begin at or before a candidate, and those that begin behind its start
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    next_ = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    touches = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("end"), F.lit(False))
    return single.withColumn("touches", touches).select("row", "doc_id", "kind", "start", "end", "base", "touches", "f.*")


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("-"))), F.lit(5)) == 0


class Model(NamedTuple):
    trees: object
    thresholds: dict[str, float]


def _scored(rows: DataFrame, trees) -> DataFrame:
    vectors = VectorAssembler(inputCols=_F, outputCol="_features").transform(rows)
    out = trees.transform(vectors).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return out.drop("_features", "rawPrediction", "probability", "prediction")


def fit(found: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: int = PRECISION) -> Model | None:
    """Trees and thresholds from :func:`candidates`; None without examples or counterexamples."""
    known = found.where(F.col("kind").isNotNull()).withColumn("label", F.col("base").cast("int"))
    cells = known.where(~_held_out(F.col("doc_id"))).groupBy(*_F, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    sample = cells.orderBy(F.xxhash64(*_F, "label"), *_F, "label").limit(sample_rows).coalesce(1)
    sample = materialise(sample, "examples")
    if sample.select("label").distinct().limit(2).count() < 2:
        return None
    vectors = VectorAssembler(inputCols=_F, outputCol="_features").transform(sample).coalesce(1)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=STEP, maxBins=64, seed=7).fit(vectors)
    held = known.where(_held_out(F.col("doc_id"))).groupBy(*_F, "kind", "label").agg(F.count(F.lit(1)).alias("n"))
    bins = _scored(held, trees).groupBy("kind", F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("all"))
    from_top = Window.partitionBy("kind").orderBy(F.desc("bin"))
    sums = bins.select("kind", "bin", F.sum("good").over(from_top).alias("good"), F.sum("all").over(from_top).alias("all"))
    fine = sums.where((100 * (F.col("good") + 1) >= precision * (F.col("all") + 2)) | ((F.col("good") == F.col("all")) & (F.col("good") > 0)))
    return Model(trees, {r["kind"]: max(LEAST_SCORE, r["bin"] / BINS) for r in fine.groupBy("kind").agg(F.min("bin").alias("bin")).collect()})


def spans(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: int = PRECISION) -> DataFrame:
    """``row, doc_id, kind, start, end, base, score``: base spans and those that the trees add.

    A document without spans has one row with no kind.
    """
    found = materialise(candidates(docs), "candidates")
    base = found.where("base").select("row", "doc_id", "kind", "start", "end", "base", F.lit(1.0).alias("score"))
    every = found.groupBy("row", "doc_id").agg(F.max("base").alias("_any")).select(
        "row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(False).alias("base"), F.lit(None).cast("double").alias("score"))
    model = fit(found, sample_rows, precision)
    if model is None or not model.thresholds:
        return base.union(every)
    threshold = F.coalesce(*(F.when(F.col("kind") == k, F.lit(t)) for k, t in model.thresholds.items()))
    free = found.where(F.col("kind").isin(*model.thresholds) & ~F.col("touches"))
    chosen = _scored(free, model.trees).where(F.col("score") >= threshold)
    # overlapping candidates form a chain; its best one stays
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = chosen.withColumn("_new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("row", "_chain").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    added = chained.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return base.union(every).union(added.select("row", "doc_id", "kind", "start", "end", "base", "score"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from :func:`spans`: one row per document."""
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(number.alias("k"), F.col("start"), F.col("end"), F.col("kind"))
    written = lambda listed: F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = found.groupBy("row", "doc_id").agg(
        *(F.sum(((F.col("kind") == k) & F.col("base")).cast("long")).alias(f"_{k}") for k in KINDS),
        F.collect_list(F.when(F.col("base"), span)).alias("_base"), F.collect_list(F.when(F.col("kind").isNotNull(), span)).alias("_all"))
    return rows.select("doc_id", *(F.coalesce(f"_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS), F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, every span replaced by its kind in brackets.

    Spans that overlap are replaced as one, by the kind of the first.
    """
    row = fresh(docs, "_row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    one = numbered.select(F.col(row).alias("doc_id"), "text")
    found = spans(one, **options).where(F.col("kind").isNotNull())
    listed = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    joined = numbered.join(listed, numbered[row] == listed["_id"], "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        out = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(inside, state["out"]).otherwise(out).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate("_spans", start, step, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn("text", F.coalesce(done, text)).select(*docs.columns)
