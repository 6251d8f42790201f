"""Text cleaning steps as column expressions.

Each step maps a string column to a string column and stays on the JVM. The
patterns carry ``(?U)`` so that ``\\w``, ``\\b``, ``\\s`` and ``\\d`` are Unicode
classes. The order in which the steps run is fixed by
:func:`corrspark.operators.clean.clean_text`.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from corrspark import lexicon

# The characters that stripping a string removes at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

PATH_PATTERN = r"(?:[A-Za-z]:)?[/][\w.-]+(?:[/][\w.-]+)*"


def sub(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, "(?U)" + pattern, replacement)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITESPACE))


def collapse_runs(col: Column) -> Column:
    """Runs of two or more blanks become one space; ends are stripped."""
    return strip(sub(col, r"\s{2,}", " "))


def collapse_all(col: Column) -> Column:
    """Any run of blanks becomes one space; ends are stripped."""
    # a single space is left as it is
    return strip(sub(col, r"\s{2,}|[\s&&[^ ]]", " "))


def words(col: Column) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(strip(col), r"(?U)\s+"), lambda w: w != "")


def replace_each(col: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Every match of a pattern replaced by what a function of it gives."""

    def put_together(found: Column) -> Column:
        pairs = F.zip_with(found["p"], F.transform(found["m"], new), lambda piece, match: F.concat(piece, F.coalesce(match, F.lit(""))))
        return F.array_join(pairs, "")

    found = F.struct(F.regexp_extract_all(col, F.lit("(?U)" + pattern), F.lit(0)).alias("m"), F.split(col, "(?U)" + pattern, -1).alias("p"))
    return F.transform(F.array(found), put_together)[0]


# --- general steps ---------------------------------------------------------


def lowercase(col: Column) -> Column:
    return F.lower(col)


def remove_puncts(col: Column) -> Column:
    bare = F.replace(F.replace(col, F.lit(";"), F.lit("")), F.lit(","), F.lit(""))
    # the dot comes first in dot patterns: what surrounds it is only looked at there
    return collapse_all(sub(bare, r"\.(?<=\w\.)(?=\s+[A-Z])"))


def remove_space_newline(col: Column) -> Column:
    return strip(sub(col, r"\s{2,}|[\n\t\r]", " "))


def remove_links(col: Column) -> Column:
    return collapse_runs(sub(col, r"(?=[hw])(?<!\w)(?:https?://\S+|www\.\S+)"))


def remove_digits(col: Column) -> Column:
    return collapse_runs(sub(col, r"\d+"))


def remove_punctuation(col: Column, preserve_file_extensions: bool = True) -> Column:
    doomed = string.punctuation.replace("-", "").replace("/", "")
    if preserve_file_extensions:
        col = sub(col, r"\.(?<!\w\.)(?!\w)")
        doomed = doomed.replace(".", "")
    # translate() maps the first two characters to blanks and drops the others
    return F.translate(col, "-/" + doomed, "  ")


def remove_parentheses_content(col: Column) -> Column:
    return collapse_runs(sub(col, r"\(.*?\)"))


def remove_special_characters(col: Column) -> Column:
    return collapse_runs(sub(col, r"[^\w\s]"))


def remove_dates(col: Column) -> Column:
    col = sub(col, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    col = sub(col, r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b")
    col = sub(col, r"(?i)\b(" + "|".join(lexicon.MONTHS) + r")\b")
    return collapse_runs(col)


def expand_contractions(col: Column) -> Column:
    """Irregular forms first, then suffix rules, then ``'s`` after a pronoun."""
    for short, full in lexicon.IRREGULAR_CONTRACTIONS.items():
        col = sub(col, rf"(?i)(?<!\w){short}\b", full)
    for suffix, full in lexicon.SUFFIX_CONTRACTIONS.items():
        col = sub(col, rf"(?i)(?<=\w){suffix}\b", full)
    heads = "|".join(lexicon.IS_CONTRACTION_HEADS)
    return collapse_runs(sub(col, rf"(?i)\b({heads})'s\b", "$1 is"))


def genitive(col: Column) -> Column:
    # no quote stands within a word, nor a blank: nothing is to be tried again with less
    col = sub(col, r"\b(\w++)'s\s++(\w++)\b", "$2 of $1")
    col = sub(col, r"\b(\w++)'\s++(\w++)\b", "$2 of $1")
    return collapse_runs(col)


# --- software specific steps -----------------------------------------------


def first_character(phrase: str) -> str:
    """The class of characters that a phrase can start with, in class syntax."""
    start = re.match(r"(?:\(+\??:?)*(\\[d.]|[A-Za-z])", phrase)
    if start is None or phrase[start.end() : start.end() + 1] in ("?", "*", "|"):
        raise ValueError(f"the start of {phrase!r} is not one plain character")
    return start[1].lower()


def version_pattern() -> str:
    """The version phrases as one alternation.

    Nearly all start at a word boundary, so the boundary and the characters that
    can follow it are tested once per position instead of once per phrase.
    """
    bounded = [p[2:] for p in lexicon.VERSION_PHRASES if p.startswith(r"\b")]
    others = [p for p in lexicon.VERSION_PHRASES if not p.startswith(r"\b")]
    return rf"(?i)(?:\b(?=[{''.join(sorted({first_character(p) for p in bounded}))}])(?:{'|'.join(bounded)})|{'|'.join(others)})"


def remove_versions(col: Column) -> Column:
    col = sub(col, version_pattern())
    col = sub(col, r"\s*,\s*", ", ")
    return sub(collapse_runs(col), r"\s*,\s*$")


def remove_entities(col: Column) -> Column:
    for pattern in (r"CVE-\d{4}-\d{4,7}", r"CWE-\d{1,5}", r"CAPEC-\d{1,5}"):
        col = sub(col, "(?i)" + pattern)
    return collapse_all(col)


def remove_file_paths(col: Column) -> Column:
    return collapse_all(sub(col, PATH_PATTERN))


def remove_file_names(col: Column) -> Column:
    return collapse_all(sub(col, r"\b\w+\.(" + "|".join(lexicon.FILE_EXTENSIONS) + r")\b"))


# --- language steps --------------------------------------------------------


def remove_stop_words(col: Column, stopwords=lexicon.STOPWORDS) -> Column:
    kept = F.filter(words(col), lambda w: ~F.lower(w).isin(*stopwords))
    return F.array_join(kept, " ")


def sentence_tokenization(col: Column) -> Column:
    """Sentences joined by one space: only the gaps between them change."""
    return collapse_runs(sub(col, r"(?=\s)(?<=[.!?])\s+", " "))


def advanced_tokenization(col: Column) -> Column:
    """Word tokens joined by one space; punctuation tokens are left out."""
    # a token is \w+(?:[.'\-]\w+)*, so between tokens is all but letters and what joins two of them
    return F.trim(sub(col, r"(?:[^\w.'\-]|[.'\-](?:(?!\w)|(?<!\w[.'\-])))+", " "))


# --- aggregation cleaner and field aggregates ------------------------------


def clean_for_aggregation(col: Column) -> Column:
    """Lower-case words only; null becomes the empty string."""
    col = F.translate(F.lower(F.coalesce(col, F.lit(""))), "/-", "  ")
    return collapse_all(sub(col, r"[^\w\s]"))


def clean_list(col: Column) -> Column:
    """Clean each non-empty item and keep the list."""
    items = F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.transform(items, clean_for_aggregation)


def clean_consequences(col: Column) -> Column:
    """One cleaned line per consequence: key words and values in fixed order."""

    def spell(values: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("None"))), " "), F.lit(""))

    def line(c: Column) -> Column:
        return F.concat_ws(
            " ",
            F.lit("scope"), spell(c["Scope"]),
            F.lit("impact"), spell(c["Impact"]),
            F.lit("note"), F.coalesce(c["Note"], F.lit("None")),
        )

    return F.transform(col, lambda c: clean_for_aggregation(line(c)))


def clean_skills(col: Column) -> Column:
    """Cleaned descriptions of the skills that have one."""
    kept = F.filter(col, lambda s: s["Description"].isNotNull() & (s["Description"] != ""))
    return F.transform(kept, lambda s: clean_for_aggregation(s["Description"]))


def join_list(col: Column) -> Column:
    """List items joined by one space; a null list is the empty string."""
    return F.coalesce(F.array_join(col, " "), F.lit(""))


def join_fields(*cols: Column) -> Column:
    """Fields joined by one space, empty fields kept (so gaps stay visible)."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


# --- markup ----------------------------------------------------------------


def collapse_or_null(col: Column) -> Column:
    """Collapse blanks; null and empty stay null."""
    return F.when(col != "", collapse_all(col))


def inner_text(col: Column, tags: str = "xhtml:[^>]*") -> Column:
    """Inner text of mixed content: strip the given tags only, collapse blanks.

    The XML reader has already unescaped entities, so a blanket tag strip would
    delete literal ``<...>`` in the text.
    """
    return collapse_or_null(sub(col, rf"</?{tags}>"))


# --- keyword text ----------------------------------------------------------


def uniform_string(col: Column) -> Column:
    """Canonical spelling used on both sides of a keyword comparison."""
    col = sub(col, r"\.(?<!\w\.)(?!\w{2,4})", " ")
    col = sub(col, r"\.(?<!\d\.)(?!\d)", " ")
    return collapse_all(F.lower(F.translate(col, "_-/(),;", "       ")))


def strip_parentheses(col: Column) -> Column:
    return collapse_all(sub(col, r"\(.*?\)"))


def first_parentheses(col: Column) -> Column:
    """Content of the first parentheses, or the whole text when there are none."""
    pattern = r"\((.*?)\)"
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, 1)).otherwise(col)
