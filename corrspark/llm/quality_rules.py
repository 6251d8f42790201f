"""Quality rules as a ledger of failure bits (operator 2, DataFrame functions only).

Every rule is evaluated once per text. The ledger keeps the measurements and one
bit per failed rule; a policy is a named mask over the bits, so a new policy, a
re-run of an old one or an ablation never reads a text again. :func:`judge` stores
the ledger in the shared folder; verdicts and ablations both come from what is stored.

Edge cases: a null or empty text has no words and fails ``few_words`` alone;
repeated rows are judged one by one; an empty table gives an empty ledger; columns
other than id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.llm.common import SPACE, words_of
from corrspark.session import materialise

SYMBOLS = r"[#*$%&|<>]"

#: Rule name to the condition under which a text fails it, in bit order. Append
#: only: the place of a rule is its bit.
RULES = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "shouting": "100 * n_upper > 50 * n_letters",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(BIT[r] for r in set(rules))


#: Versioned policies. A published version is never edited.
POLICIES = {
    "base": mask("few_words", "repeat_words"),
    "2024.1": mask("few_words", "repeat_words", "symbols", "dup_lines"),
    "2024.2": mask(*RULES),
}
CURRENT = "2024.2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes within the text. Sorting (hash, place)
    brings equal windows together in n log n steps; texts without an equal pair
    are not sorted.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.transform(twice, lambda x: x["i"])

        starts = F.transform(F.array(placed), places)[0]
        spread = F.transform(F.array(starts), lambda p: F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))[0]
        return F.size(F.array_distinct(spread))

    counted = F.transform(F.array(windows), lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes)))[0]
    return F.when(F.size(words) < 4, 0).otherwise(counted)


def _measure(text: Column) -> list[Column]:
    """Measurements of one text as columns; ``text`` must not be null."""
    worded = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.filter(lines, lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))))[0]
    lines = F.transform(F.array(worded), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0]
    words = F.transform(F.array(words_of(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))[0]
    return [
        words.alias("_words"), lines.alias("_lines"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{L}")).alias("n_letters"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
    ]


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, the measurements and ``failed`` (bits of failed rules)."""
    measured = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(key, *_measure(F.col("_text")))
    named = {"n_words": "_words.n", "n_repeat_words": "_words.repeat", "n_lines": "_lines.n", "n_dup_lines": "_lines.dup"}
    plain = measured.select(key, *(F.col(named.get(m, m)).cast("long").alias(m) for m in MEASURES))
    bits = sum((F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES.items()), F.lit(0))
    return plain.withColumn("failed", bits.cast("long"))


def passes(policy: int, failed: str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(policy)) == 0


def histogram(book: DataFrame) -> DataFrame:
    """Texts per distinct bit pattern, at most 2 ** rules rows: what all ablations need."""
    return book.groupBy("failed").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(counts: DataFrame, policy: int) -> DataFrame:
    """For every rule of a policy: texts it fails, fails alone, and kept texts without it."""
    inside = F.col("failed").bitwiseAND(F.lit(policy))
    each = [
        F.struct(
            F.lit(name).alias("rule"),
            F.sum(F.when(inside.bitwiseAND(F.lit(bit)) != 0, F.col("n_docs")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(inside == bit, F.col("n_docs")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(inside.bitwiseAND(F.lit(policy & ~bit)) == 0, F.col("n_docs")).otherwise(0)).alias("n_kept_without"),
        )
        for name, bit in BIT.items() if policy & bit
    ]
    if not each:
        return counts.sparkSession.createDataFrame([], "rule string, n_failed long, n_failed_alone long, n_kept_without long")
    return counts.agg(F.array(*each).alias("each")).select(F.inline("each"))


def verdicts(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed``, the verdict ``kept`` of a policy, and its ablation.

    ``decided_by`` is the rule without which the policy would keep the text (null:
    kept, or several rules fail), ``n_decided`` how many texts that rule alone fails.
    """
    inside = POLICIES[policy] | POLICIES["base"]
    alone = F.col("failed").bitwiseAND(F.lit(inside))
    effect = ablations(histogram(book), inside).select(F.col("rule").alias("decided_by"), F.col("n_failed_alone").alias("n_decided"))
    judged = book.select(
        "doc_id", *MEASURES, "failed",
        (~passes(POLICIES["base"])).alias("base_failed"),
        passes(inside).alias("kept"),
        F.coalesce(*(F.when(alone == bit, F.lit(name)) for name, bit in BIT.items() if inside & bit)).alias("decided_by"),
    )
    return judged.join(F.broadcast(effect), "decided_by", "left")  # one row per rule


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The stored ledger of all texts under a policy, see :func:`verdicts`."""
    return verdicts(materialise(ledger(docs), "ledger"), policy)


# "10 * n_symbols > n_words" and the other thresholds are in RULES; the same text serves SQL.
_FAILED = " + ".join(f"CASE WHEN {condition} THEN {BIT[name]} ELSE 0 END" for name, condition in RULES.items())
_INSIDE = POLICIES[CURRENT] | POLICIES["base"]
_ALONE = " ".join(f"WHEN {bit} THEN '{name}'" for name, bit in BIT.items() if _INSIDE & bit)
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
             CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM m),
a AS (SELECT *, CASE failed & {_INSIDE} {_ALONE} END AS decided_by FROM b)
SELECT *, CASE WHEN decided_by IS NOT NULL THEN count(*) OVER (PARTITION BY decided_by) END AS n_decided, (failed & {POLICIES["base"]}) <> 0 AS base_failed, (failed & {POLICIES[CURRENT] | POLICIES["base"]}) = 0 AS kept FROM a
"""
