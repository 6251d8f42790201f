"""Platform names (CPE URIs): parsing, aggregation, matching and masking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corrspark import lexicon
from corrspark.functions import words as W
from corrspark.functions.pieces import pieces
from corrspark.functions.text import collapse_all, strip
from corrspark.session import materialise

PREFIX = "cpe:2.3:"
# The fields of a CPE 2.3 URI after its prefix, in order.
URI_FIELDS = (
    "part", "vendor", "product", "version", "update", "edition",
    "language", "sw_edition", "target_sw", "target_hw", "other",
)
# The fields kept by parse, in their output order.
PARSED_FIELDS = ("part", "vendor", "product", "version", "update", "edition", "sw_edition", "language", "target_sw")
# The fields collected per (part, vendor, product).
DETAIL_FIELDS = ("version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw")


def uri_parts(uri: Column, escaped: bool = False) -> Column:
    """Colon-separated parts; ``escaped`` keeps colons behind a backslash."""
    return F.split(uri, r"(?<!\\):" if escaped else ":")


def parse_uris(df: DataFrame, uri: str, escaped: bool = False) -> DataFrame:
    """Add the nine parsed fields; URIs with fewer than 11 parts are dropped."""
    parts = uri_parts(F.col(uri), escaped)
    rows = df.withColumn("_parts", parts).filter(F.size("_parts") >= 11)
    place = {name: i + 2 for i, name in enumerate(URI_FIELDS)}
    return rows.select(*df.columns, *[F.get("_parts", F.lit(place[f])).alias(f) for f in PARSED_FIELDS])


def aggregate_uris(df: DataFrame, uri: str, keys: tuple[str, ...] = (), pos: str | None = None) -> DataFrame:
    """Distinct detail values per (part, vendor, product), in order of appearance.

    Each value is reduced to its first position before values meet, so repeats of
    one product cost one row per task. ``*`` and ``-`` are no values; missing
    trailing fields count as ``*``.
    """
    at = lambda name: F.get("_p", F.lit(URI_FIELDS.index(name) + 2))
    order = F.col(pos).cast("long") if pos else F.lit(0).cast("long")
    # up to the product, one string; rows are filtered after the explode only, since a
    # filter here would move below and make the URI again for every test
    name = F.substring_index(uri, ":", URI_FIELDS.index("product") + 3).alias("_n")
    rows = df.select(*keys, order.alias("_o"), name, uri_parts(F.col(uri)).alias("_p"))
    scheme, version, _ = PREFIX.split(":")
    good = (F.size("_p") >= 10) & (F.get("_p", F.lit(0)) == scheme) & (F.get("_p", F.lit(1)) == version)
    rows = rows.withColumn("_p", F.when(good, F.col("_p")))
    is_value = lambda f: ~at(f).isin("*", "-")
    details = [F.when(is_value(f), F.struct(F.lit(i).alias("f"), at(f).alias("v"))) for i, f in enumerate(DETAIL_FIELDS)]
    bare = F.col("_p").isNotNull() & reduce(and_, [~F.coalesce(is_value(f), F.lit(False)) for f in DETAIL_FIELDS])
    details.append(F.when(bare, F.struct(F.lit(None).cast("int").alias("f"), F.lit(None).cast("string").alias("v"))))
    long_rows = rows.select(*keys, "_n", "_o", F.explode_outer(F.array(*details)).alias("d")).filter(F.col("d").isNotNull())
    first = long_rows.groupBy(*keys, "_n", F.col("d.f").alias("f"), F.col("d.v").alias("v")).agg(F.min("_o").alias("_o"))
    # distinct values meet by product before they become lists; the hash leads the keys,
    # so that sorting by them seldom compares names
    group = [*keys, "_n"]
    entries = F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "_o", "v")))).alias("_e")
    gathered = first.repartition(*group).groupBy(F.xxhash64(*group).alias("_h"), *group).agg(F.min("_o").alias("first_pos"), entries)
    named = gathered.withColumn("_p", uri_parts(F.col("_n")))
    of_field = lambda i: F.transform(F.filter("_e", lambda e: e["f"] == i), lambda e: e["v"])
    lists = [of_field(i).alias(f"{f}s") for i, f in enumerate(DETAIL_FIELDS)]
    return named.select(*keys, *[at(f).alias(f) for f in ("part", "vendor", "product")], "first_pos", *lists)


def part_label(part: Column) -> Column:
    label = part
    for letter, name in lexicon.CPE_PARTS.items():
        label = F.when(part == letter, name).otherwise(label)
    return label


def normalise_name(col: Column) -> Column:
    return F.lower(strip(F.replace(col, F.lit("_"), F.lit(" "))))


def vendor_of(uri: Column) -> Column:
    return F.get(F.split(uri, ":"), F.lit(3))


def product_of(uri: Column) -> Column:
    return F.get(F.split(uri, ":"), F.lit(4))


# --- matching --------------------------------------------------------------

MATCH = "array<struct<matched: string, position: int, length: int>>"
TERM_MATCH = "array<struct<term: string, matched: string, position: int, length: int>>"


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def column_spans(text: Column, pattern: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The matches of a pattern column that are wanted: matched text, position, length.

    One pass over the matches: a match stands behind all pieces and matches before it.
    """

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found["m"], F.slice(found["p"], 1, F.size(found["m"])), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

        def step(state: Column, x: Column) -> Column:
            at = state["at"] + F.length(x["p"])
            match = F.array(F.struct(x["m"].alias("matched"), at.alias("position"), F.length(x["m"]).alias("length")))
            keep = F.lit(True) if wanted is None else wanted(x["m"])
            return F.struct((at + F.length(x["m"])).alias("at"), F.when(keep, F.concat(state["out"], match)).otherwise(state["out"]).alias("out"))

        return F.aggregate(pairs, start, step, lambda state: state["out"])

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.transform(F.array(found), placed)[0].cast(MATCH)


def exact_matches(text: Column, term: Column) -> Column:
    """A term as a whole, case aside, in the lower-cased text."""
    return column_spans(F.lower(text), F.concat(F.lit(r"(?iU)\b"), quoted(F.lower(term)), F.lit(r"\b")))


def _join(patterns: Column, between: str) -> Column:
    return F.array_join(patterns, between)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def blank_parts(text: Column) -> Column:
    """The parts of a text between blanks (a split by one character compiles no pattern)."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


# how a pattern starts that finds a name whatever its case
ANY_CASE = r"(?iU)\b"
GAP = r"\s+"


def _whole(start: Column, name: Column) -> Column:
    return F.concat(start, quoted(name), F.lit(r"\b"))


def _head_shape(start: Column, vendor: Column, product: Column) -> Column:
    """The first word of the vendor before the product."""
    return F.concat(start, quoted(F.get(blank_parts(vendor), F.lit(0))), F.lit(r"\b" + GAP), quoted(product))


def _vendor_shape(start: Column, vendor: Column, product: Column) -> Column:
    """The vendor before the product, with up to two words in between."""
    return F.concat(start, quoted(vendor), F.lit(r"\b\s+(?:\w+\s+){0,2}"), quoted(product))


def _all_but(words: Column, i: Column) -> Column:
    return F.filter(words, lambda _, k: k != i)


def _words_shape(start: Column, words: Column) -> Column:
    """Words in their order."""
    return F.concat(start, F.lit("(?:"), _join(F.transform(words, quoted), GAP), F.lit(r")\b"))


def partial_shapes(vendor: Column, product: Column) -> Column:
    """Near spellings of a product name as an array of patterns.

    Without vendor: the product with one word left out. With vendor: its first
    word before the product, and the vendor with up to two words in between.
    """
    start, who, name = F.lit(ANY_CASE), F.lower(vendor), F.lower(product)
    named = F.array(_head_shape(start, who, name), _vendor_shape(start, who, name))

    def left_out(words: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(words) - 1)
        return F.when(F.size(words) > 1, F.transform(each, lambda i: _words_shape(start, _all_but(words, i))))

    without = F.coalesce(_let(blank_parts(name), left_out), F.array().cast("array<string>"))
    return F.when(F.coalesce(vendor, F.lit("")) != "", named).otherwise(without)


def partial_matches(text: Column, vendor: Column, product: Column) -> Column:
    """Matches of every shape, shape by shape."""
    return F.flatten(F.transform(partial_shapes(vendor, product), lambda shape: column_spans(text, shape)))


def replace_split_word(text: Column, word: Column, replacement: Column | str) -> Column:
    """Replace a word that blanks break into two or three parts."""
    letters = _join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), quoted), r"\s*")
    pattern = F.concat(F.lit(r"(?iU)\b"), letters, F.lit(r"\b"))
    replacement = F.lit(replacement) if isinstance(replacement, str) else replacement

    def put_together(found: Column) -> Column:
        parts = lambda m: F.size(F.split(m, r"\s+"))
        new = F.transform(found["m"], lambda m: F.when(parts(m).isin(2, 3), replacement).otherwise(m))
        pairs = F.zip_with(found["p"], new, lambda piece, match: F.concat(piece, F.coalesce(match, F.lit(""))))
        return F.array_join(pairs, "")

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    rule = F.transform(F.array(found), put_together)[0]
    return F.when((F.length(word) < 2) | F.contains(word, F.lit(" ")), text).otherwise(rule)


# --- near spellings --------------------------------------------------------


def least_common(total: Column, threshold: int) -> Column:
    """Letters in common that two words of ``total`` letters need to be more than ``threshold`` percent alike.

    The ratio is rounded half to even, so an odd threshold takes the half itself.
    """
    share = (2 * threshold + 1) * total
    return (F.floor(share / 400) + 1 if threshold % 2 == 0 else F.ceil(share / 400)).cast("int")


# letters that one bit row holds
ROW_BITS = 62


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two words.

    One row of bits per letter of ``b`` while ``a`` has at most ``ROW_BITS`` letters,
    else a row of lengths.
    """
    letters = lambda w: F.filter(F.split(w, ""), lambda c: c != "")

    def by_bits(own: Column) -> Column:
        places = F.transform(own, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("bit")))
        full = (F.call_function("shiftleft", F.lit(1).cast("long"), F.size(own)) - 1).cast("long")
        zero = F.lit(0).cast("long")

        def step(row: Column, c: Column) -> Column:
            hit = row.bitwiseAND(F.aggregate(places, zero, lambda m, x: F.when(x["c"] == c, m + x["bit"]).otherwise(m)))
            # the hit letters are bound once
            return F.transform(F.array(hit), lambda h: (row + h).bitwiseOR(row - h).bitwiseAND(full))[0]

        return F.size(own) - F.bit_count(F.aggregate(letters(b), full, step))

    def by_lengths(own: Column) -> Column:
        start = F.transform(F.concat(F.array(F.lit("")), own), lambda _: F.lit(0))

        def step(row: Column, c: Column) -> Column:
            def cell(done: Column, x: Column) -> Column:
                return F.concat(done, F.array(F.when(x["c"] == c, x["diagonal"] + 1).otherwise(F.greatest(x["above"], F.element_at(done, -1)))))

            cells = F.transform(own, lambda o, i: F.struct(o.alias("c"), F.get(row, i).alias("diagonal"), F.get(row, i + 1).alias("above")))
            return F.aggregate(cells, F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(letters(b), start, step), -1)

    return F.transform(F.array(letters(a)), lambda own: F.when(F.size(own) <= ROW_BITS, by_bits(own)).otherwise(by_lengths(own)))[0]


def ratio(a: Column, b: Column) -> Column:
    """Indel similarity 0..100: twice the letters in common by all letters, rounded half to even."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100).otherwise(F.bround(200.0 * common_length(a, b) / total, 0).cast("int"))


def is_close(word: Column, term: Column, threshold: int = 70) -> Column:
    """Whether two words are more than ``threshold`` percent alike.

    Lengths and the edit distance decide nearly all pairs: with replaced letters
    counted once, it is at most the indel distance and at least its half. It is
    worked out only as far as that, and of the rest the letters that the other word
    has at all bound what they have in common.
    """
    total = F.length(word) + F.length(term)
    needed = least_common(total, threshold)
    most = F.greatest(total - 2 * needed, F.lit(0))
    edits = F.call_function("levenshtein", word, term, most)  # -1: more than that
    own = lambda a, b: F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    # whether the shorter word has fewer letters than needed, without a division
    shorter, share = 400 * F.least(F.length(word), F.length(term)).cast("long"), (2 * threshold + 1) * total.cast("long")
    too_short = shorter <= share if threshold % 2 == 0 else shorter < share
    return (
        F.when(too_short, False).when(edits < 0, False).when(2 * edits <= most, True)
        .when(F.least(own(word, term), own(term, word)) < needed, False).otherwise(common_length(word, term) >= needed)
    )


WORD = r"(?U)\w+"


class _Close(dict):
    """Whether words are like one term, each worked out once."""

    def __init__(self, term: str, threshold: int):
        super().__init__()
        self.term, self.threshold = term, threshold

    def fits(self, size: int) -> bool:
        """Whether the lengths allow it."""
        return min(size, len(self.term)) >= self.needed(size)

    def needed(self, size: int) -> int:
        """:func:`least_common` of a word of ``size`` letters."""
        share = (2 * self.threshold + 1) * (size + len(self.term))
        return share // 400 + 1 if self.threshold % 2 == 0 else -(-share // 400)

    def __missing__(self, word: str) -> bool:
        self[word] = out = self.fits(len(word)) and W.common_length(word, self.term) >= self.needed(len(word))
        return out


#: Words that a task remembers as compared, at most (but for those of one piece).
KNOWN_WORDS = 1 << 18


def _close_places(words: list[str], asked: list[str | None], known: dict[str, _Close], threshold: int) -> Iterator[tuple[int, int]]:
    """(term, word) numbers of the words of one text that are like a term."""
    longest = max(map(len, words), default=0)
    for k, term in enumerate(asked):
        if term is None:
            continue
        close = known.get(term)
        if close is None:
            close = known[term] = _Close(term, threshold)
        if longest < len(term) and not close.fits(longest):
            continue  # nor do the lengths of the other words
        yield from ((k, i) for i, w in enumerate(words) if close[w])


def _starts(words: pa.Array, gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words in their texts, and per row where its first one stands in that list."""
    size = lambda xs: np.nan_to_num(pc.list_value_length(xs).to_numpy(zero_copy_only=False)).astype(np.int64)
    letters = lambda xs: pc.utf8_length(xs.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    n, lengths = size(words), letters(words)
    first, first_gap = np.cumsum(n) - n, np.cumsum(size(gaps)) - size(gaps)
    row = np.repeat(np.arange(len(n)), n)
    before = letters(gaps)[np.arange(len(lengths)) - first[row] + first_gap[row]]  # the piece before each word
    ends = np.cumsum(before + lengths)
    base = np.concatenate([[0], ends])[first]
    return ends - lengths - base[row], first


PLACES = pa.struct([("term", pa.int32()), ("word", pa.int32()), ("position", pa.int32())])


def fuzzy_matches_each(text: Column, terms: Column, threshold: int = 70) -> Column:
    """Words of a text that resemble the terms of a list: term, matched text, position, length.

    Words, the pieces between them and terms come from column expressions; tasks
    compare each distinct pair once, as far as they remember it. Null terms are like
    nothing.
    """

    @F.arrow_udf("array<struct<term: int, word: int, position: int>>")
    def close(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known: dict[str, _Close] = {}
        for batch in batches:
            for start, size in pieces(batch[0]):
                if len(known) + sum(map(len, known.values())) > KNOWN_WORDS:
                    known.clear()
                words, low, gaps, asked = (c.slice(start, size) for c in batch)
                places, first = _starts(words, gaps)
                found, ends = [], [0]
                for row, (own, wanted) in enumerate(zip(low.to_pylist(), asked.to_pylist())):
                    if own is not None and wanted is not None:
                        found += [(k, i, first[row] + i) for k, i in _close_places(own, wanted, known, threshold)]
                    ends.append(len(found))
                k, i, at = np.array(found, np.int64).reshape(-1, 3).T
                match = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (k, i, places[at])], fields=list(PLACES))
                none = pc.or_(pc.is_null(low), pc.is_null(asked))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), match, mask=none)

    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def named(x: Column) -> Column:
        word = lambda m: F.get(x["words"], m["word"])
        return F.transform(x["found"], lambda m: F.struct(
            F.get(terms, m["term"]).alias("term"), word(m).alias("matched"), m["position"].alias("position"), F.length(word(m)).alias("length")))

    found = close(words, low(words), F.split(text, WORD, -1), low(terms))
    return F.transform(F.array(F.struct(found.alias("found"), words.alias("words"))), named)[0].cast(TERM_MATCH)


def fuzzy_matches(text: Column, term: Column, threshold: int = 70) -> Column:
    """Words of a text that resemble the term."""
    found = fuzzy_matches_each(text, F.array(term), threshold)
    return F.transform(found, lambda m: F.struct(m["matched"].alias("matched"), m["position"].alias("position"), m["length"].alias("length"))).cast(MATCH)


def fuzzy_runs(term: str, text: str, threshold: int = 70) -> list[tuple[str, int, int, bool]]:
    """Runs of words that resemble the term: (run, position, length, open).

    All windows as long as the term are compared at once, one row of bits each. A run
    that holds a window above the threshold matches, and so does every longer run
    from its start: of these the shortest is given, as ``open``. Runs shorter than
    the term, which are compared with its windows, are given one by one. So the
    result is whole, and linear in the text.
    """
    return _fuzzy_runs_each([term], [text], threshold)[0]


def _fuzzy_runs_each(terms: list[str], texts: list[str], threshold: int) -> list[list[tuple[str, int, int, bool]]]:
    """:func:`fuzzy_runs` of every term and text: the windows of all of them are compared together."""
    out: list[list] = [[] for _ in terms]
    asked, pairs = [], []  # per text its words and runs; what is to be compared
    for row, (term, text) in enumerate(zip(terms, texts)):
        term, low = term.lower(), text.lower()
        found = [m.span() for m in re.finditer(r"\w+", text)]
        size = len(term)
        if not found or not size:
            continue
        if len(low) != len(text):
            out[row] = _fuzzy_runs_plain(term, text, found, threshold)
            continue
        short = []
        for i, (start, _) in enumerate(found):
            for _, end in found[i:]:
                if end - start >= size:
                    break
                short.append((start, end))
        asked.append((row, size, found, short, len(pairs)))
        pairs += [(term, low), *((low[start:end], term) for start, end in short)]
    good = _close_windows(pairs, threshold)
    for row, size, found, short, at in asked:
        text, ends = texts[row], np.array([e for _, e in found])
        done = [(text[start:end], start, end - start, False) for (start, end), near in zip(short, good[at + 1:at + 1 + len(short)]) if len(near)]
        starts = np.array([s for s, _ in found])
        # the first window from each word on, and the first word that ends behind it
        window = np.append(good[at], len(text) + size)[np.searchsorted(good[at], starts)]
        for start, k in zip(starts.tolist(), np.searchsorted(ends, window + size).tolist()):
            if k < len(found):
                done.append((text[start:found[k][1]], start, found[k][1] - start, True))
        out[row] = sorted(done, key=lambda m: m[1:3])
    return out


def _fuzzy_runs_plain(term: str, text: str, found: list[tuple[int, int]], threshold: int) -> list[tuple[str, int, int, bool]]:
    """The same, run by run, for texts whose length changes with the case."""
    out = []
    for i, (start, _) in enumerate(found):
        for _, end in found[i:]:
            run = text[start:end].lower()
            if W.partial_ratio(run, term) > threshold:
                out.append((text[start:end], start, end - start, len(run) >= len(term)))
                if len(run) >= len(term):
                    break
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


#: Windows that are compared at a time, at most (but for those of one text).
WINDOWS = 1 << 18


def _close_windows(pairs: list[tuple[str, str]], threshold: int) -> list[np.ndarray]:
    """Per (pattern, text): where the windows as long as the pattern start that are more alike than the threshold.

    Pairs with patterns of one length are compared together, one row of bits per window.
    """
    out = [np.zeros(0, np.int64)] * len(pairs)
    by_size: dict[int, list[int]] = {}
    for i, (pattern, text) in enumerate(pairs):
        if len(pattern) > ROW_BITS:
            windows = range(len(text) - len(pattern) + 1)
            out[i] = np.array([o for o in windows if W.ratio(text[o:o + len(pattern)], pattern) > threshold], np.int64)
        elif 0 < len(pattern) <= len(text):
            by_size.setdefault(len(pattern), []).append(i)
    for size, own in by_size.items():
        ends = np.cumsum([len(pairs[i][1]) for i in own])
        start = 0
        while start < len(own):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + WINDOWS, "right")))
            some = own[start:stop]
            pair, offset = _close_of_size([pairs[i][0] for i in some], [pairs[i][1] for i in some], size, threshold)
            first = np.searchsorted(pair, np.arange(len(some) + 1))
            for k in np.unique(pair).tolist():
                out[some[k]] = offset[first[k]:first[k + 1]]
            start = stop
    return out


def _close_of_size(patterns: list[str], texts: list[str], size: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, offset) of the windows that are alike, for patterns of one size."""
    lengths = np.array([len(t) for t in texts])
    row, letters, spelled = np.repeat(np.arange(len(texts)), lengths), _codes(texts), _codes(patterns).reshape(-1, size)
    hits = np.zeros(len(letters), np.int64)
    for i in range(size):
        hits |= (spelled[row, i] == letters).astype(np.int64) << i
    offset = np.arange(len(letters)) - (np.cumsum(lengths) - lengths)[row]
    at = np.flatnonzero(offset <= lengths[row] - size)
    full = (1 << size) - 1
    state = np.full(len(at), full, np.int64)
    for k in range(size):
        hit = state & hits[at + k]
        state = ((state + hit) | (state - hit)) & full
    alike = np.rint(100 * (size - np.bitwise_count(state).astype(int)) / size) > threshold
    return row[at[alike]], offset[at[alike]]


RUN = "array<struct<matched: string, position: int, length: int, open: boolean>>"
RUNS = pa.struct([("matched", pa.string()), ("position", pa.int32()), ("length", pa.int32()), ("open", pa.bool_())])
#: Bytes of text whose runs are Python objects at a time.
RUN_BYTES = 1 << 18


def fuzzy_span_matches(text: Column, term: Column, threshold: int = 70) -> Column:
    """Runs of words that resemble the term, without a bound on their length (see :func:`fuzzy_runs`)."""

    @F.arrow_udf(RUN)
    def run(texts: pa.Array, terms: pa.Array) -> pa.Array:
        done = []
        for start, size in pieces(texts, RUN_BYTES):
            own, asked = texts.slice(start, size).to_pylist(), terms.slice(start, size).to_pylist()
            known = [i for i, (t, w) in enumerate(zip(own, asked)) if t is not None and w is not None]
            found: list[list | None] = [None] * size
            for i, runs in zip(known, _fuzzy_runs_each([asked[i] for i in known], [own[i] for i in known], threshold)):
                found[i] = runs
            flat = list(zip(*(m for runs in found if runs for m in runs))) or [()] * 4
            ends = np.cumsum([0, *(len(runs or ()) for runs in found)])
            match = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, RUNS)], fields=list(RUNS))
            done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), match, mask=pa.array([runs is None for runs in found])))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(RUNS))

    return run(text, term)


def _least_pairs(total: Column, threshold: int, skip: int) -> Column:
    """Pairs that words of ``total`` letters share at least.

    Each step of their common letters that skips too much costs ``skip + 1`` others.
    """
    needed = least_common(total, threshold)
    return needed - 1 - F.floor((total - 2 * needed) / (skip + 1))


# from here on words of one letter are like no others, and one skipped letter is enough
PAIRS_FROM = 70


def _parts(rows: DataFrame, threshold: int) -> DataFrame:
    """(word, part): numbered pairs of letters with at most one letter between, or the numbered letters."""
    size = F.length("word")
    at = lambda i: F.substring("word", i, 1)
    if threshold < PAIRS_FROM:
        listed = F.transform(F.sequence(F.lit(1), size), at)
    else:
        gaps = lambda i: F.array(*[F.when(i + gap <= size, F.concat(at(i), at(i + gap))) for gap in (1, 2)])
        listed = F.when(size == 1, F.array("word")).otherwise(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), size), gaps))))
    parts = rows.select("word", F.explode(listed).alias("part")).groupBy("word", "part").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return parts.select("word", F.explode(F.transform(F.sequence(F.lit(1), "k"), lambda k: F.concat("part", F.lit(" "), k.cast("string")))).alias("part"))


def fuzzy_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, threshold: int = 70) -> DataFrame:
    """(term, word, score, n): words of all texts that resemble a catalogue term.

    A join of distinct words on what alike words must share: pairs of letters that
    stand beside each other or with one between, numbered where they repeat (below
    ``PAIRS_FROM`` percent the letters themselves). From its length follows how many
    of its parts a term shares with any match, so it offers all but the most frequent
    ones less one. Words and terms that meet there, and whose lengths allow it, are
    compared. Work grows with these candidates, not with words times terms, and
    none is lost.
    """
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    counted = materialise(texts.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    needles = terms.select(F.lower(term).alias("word")).filter(F.col("word") != "").distinct()
    ours, theirs = _parts(counted.select("word"), threshold), _parts(needles, threshold)
    size = F.length("word")

    def shared_with(other: Column) -> Column:
        total = size + other
        needed = least_common(total, threshold)
        least = needed if threshold < PAIRS_FROM else F.when(total > 2, _least_pairs(total, threshold, 1)).otherwise(1)
        return F.when(F.least(size, other) >= needed, least)

    # a match is at most three times as long from 50 percent on, below that up to 400 / threshold times
    longest = F.ceil(size * (400 / max(threshold, 1))).cast("int") + 1
    shared = F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(F.lit(1), longest), shared_with)))
    held = ours.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    rare = Window.partitionBy("word").orderBy("held", "part")
    ranked = theirs.join(held, "part", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("_at", F.row_number().over(rare))
    offered = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("word"))).filter((F.col("_at") <= F.col("_n") - shared + 1) & (F.col("held") > 0))
    met = offered.select(F.col("word").alias("term"), "part").join(ours, "part").select("term", "word")
    total = F.length("word") + F.length("term")
    met = met.filter(F.least(F.length("word"), F.length("term")) >= least_common(total, threshold)).distinct()
    close = met.filter(is_close(F.col("word"), F.col("term"), threshold))
    return close.join(counted, "word").select("term", "word", ratio(F.col("word"), F.col("term")).alias("score"), "n")


# --- masking ---------------------------------------------------------------

# Fixed value: what may stand between repeats of a label.
REPEAT_GAP = r"[\s,.;:]*"


# a printable ASCII text without capitals whose only blank is the space: case and alphabet make no difference in it
PLAIN = r"\A[ -@\[-~]*\z"


def _products(uris: Column) -> Column:
    """The URIs of one row in parts, those of one (part, vendor, product) together, in order of appearance."""
    scheme, version, _ = PREFIX.split(":")

    def gathered(rows: Column) -> Column:
        name = lambda p: F.array_join(F.slice(p, 3, 3), ":")
        groups = F.transform(F.array_distinct(F.transform(rows, name)), lambda k: F.filter(rows, lambda p: name(p) == k))
        return F.when(F.size(rows) == 1, F.array(rows)).otherwise(groups)

    good = lambda p: (F.size(p) >= 10) & (p[0] == scheme) & (p[1] == version)
    return _let(F.filter(F.transform(uris, lambda u: F.split(u, ":")), good), gathered)


def _details(own: Column, *runs: tuple[str, str]) -> Column:
    """The distinct values of each field, field by field, from the URIs of one product; fields are given as runs from one to another."""
    places = [(URI_FIELDS.index(first) + 2, URI_FIELDS.index(last) + 2) for first, last in runs]
    one = F.concat(*[F.slice(own[0], first + 1, last - first + 1) for first, last in places])
    each = F.array(*[F.lit(i) for first, last in places for i in range(first, last + 1)])
    values = lambda i: F.array_compact(F.array_distinct(F.transform(own, lambda p: F.get(p, i))))
    return F.array_remove(F.array_remove(F.when(F.size(own) == 1, one).otherwise(F.flatten(F.transform(each, values))), "*"), "-")


def _long_words(text: Column, least: Column) -> Column:
    """The words of a text, of which short ones may be left out that have fewer letters than wanted."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    for size in (4, 6, 9, 16):  # a pattern for each size would have to be made for each text
        words = F.when(least >= size, F.regexp_extract_all(text, F.lit(rf"(?U)\w{{{size},}}"), F.lit(0))).otherwise(words)
    return words


def _near_pattern(text: Column, term: Column, threshold: int = 70) -> Column:
    """A pattern of the words of a text that resemble the term; null if there is none."""
    share = (2 * threshold + 1) / 400
    # what the lengths rule out, and most of what the edits rule out, in few steps (see is_close)
    length = F.length(term)
    bounds = F.struct(length.alias("length"), F.ceil(length * (share / (1 - share)) - 1e-6).alias("least"), F.floor(length * ((1 - share) / share) + 1e-6).alias("most"))

    def pattern(size: Column) -> Column:
        edits = lambda w: F.call_function("levenshtein", w, term, ((F.length(w) + size["length"]) * (1 - 2 * share)).cast("int"))
        may = lambda w: (F.length(w) >= size["least"]) & (F.length(w) <= size["most"]) & (edits(w) >= 0)
        words = F.array_distinct(F.filter(_long_words(text, size["least"]), may))
        return _let(F.filter(words, lambda w: is_close(w, term, threshold)),
                    lambda c: F.when(F.size(c) > 0, F.concat(F.lit(r"(?U)\b(?:"), F.array_join(c, "|"), F.lit(r")\b"))))

    return _let(bounds, pattern)


def _masked(text: Column, own: Column) -> Column:
    """The steps of one product on a text, one after the other, from its URIs in parts.

    A pattern is made and searched only where its words are in the text. Only plain
    texts and names can be asked that way, others are searched whatever they hold.
    """
    label = part_label(own[0][2])
    names = F.struct(normalise_name(own[0][3]).alias("vendor"), normalise_name(own[0][4]).alias("product"), label.alias("label"))

    def of_product(x: Column) -> Column:
        vendor, product = x["vendor"], x["product"]
        new = F.replace(F.replace(x["label"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        marks = F.struct(new.alias("new"), F.concat(F.substring_index(vendor, " ", 1), F.lit(" ")).alias("ahead"), F.concat(F.lit(" "), product).alias("behind"),
                         F.rlike(F.concat(text, vendor, product, x["label"]), F.lit(PLAIN)).alias("plain"))
        return _let(marks, lambda m: steps(vendor, product, x["label"], m["new"], m["ahead"], m["behind"], m["plain"]))

    def steps(vendor: Column, product: Column, label: Column, new: Column, ahead: Column, behind: Column, plain: Column) -> Column:
        full = F.concat(vendor, behind)
        start = F.when(plain, r"\b").otherwise(ANY_CASE)
        sub = lambda t, pattern, when: F.when(when, F.regexp_replace(t, pattern, new)).otherwise(t)

        def exact(name: Column) -> Callable[[Column], Column]:
            return lambda t: sub(t, _whole(start, name), F.contains(t, name))

        def after(shape: Callable[[Column, Column, Column], Column]) -> Callable[[Column], Column]:
            return lambda t: sub(t, shape(start, vendor, product), (vendor != "") & F.contains(t, product))

        def named(t: Column) -> Column:
            return F.when(~plain | (F.contains(t, ahead) & F.contains(t, behind)), _in_turn(t, exact(full), after(_head_shape), after(_vendor_shape))).otherwise(t)

        def near(term: Column) -> Callable[[Column], Column]:
            return lambda t: _let(_near_pattern(t, term), lambda p: sub(t, p, p.isNotNull()))

        def left_out(t: Column) -> Column:
            def each(words: Column) -> Column:
                def one(done: Column, i: Column) -> Column:
                    held = F.forall(_all_but(words, i), lambda w: F.contains(done, w))
                    return sub(done, _words_shape(start, _all_but(words, i)), ~plain | held)

                # a text without two of the words has none of the shapes
                may = (F.size(words) > 1) & (~plain | (F.size(F.filter(words, lambda w: ~F.contains(t, w))) < 2))
                return F.when(may, F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), t, one)).otherwise(t)

            return _let(F.when(plain, F.array_remove(F.split(product, " "), "")).otherwise(blank_parts(product)), each)

        def split(t: Column) -> Column:
            can_break = lambda word: (F.length(word) > 1) & ~F.contains(word, F.lit(" "))

            def step(word: Column, label: Column) -> Callable[[Column], Column]:
                squeezed = lambda t: F.when(plain, F.replace(t, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(t, r"\s+", ""))
                return lambda t: F.when(can_break(word) & F.contains(squeezed(t), word), replace_split_word(t, word, label)).otherwise(t)

            return F.when(can_break(vendor) | can_break(product), _in_turn(t, step(vendor, F.lit("")), step(product, label))).otherwise(t)

        def details(t: Column) -> Column:
            gone = lambda done, v: F.when((v == vendor) | (v == product), done).otherwise(F.replace(done, F.lower(v), F.lit("")))
            done = F.aggregate(_details(own, ("target_sw", "target_sw")), t, lambda done, v: F.replace(done, F.lower(v), F.lit("software")))
            return F.aggregate(_details(own, ("version", "sw_edition"), ("target_hw", "target_hw")), done, gone)

        def without_vendor(t: Column) -> Column:
            pattern = _whole(start, vendor)
            return F.when(F.contains(t, vendor) & F.rlike(t, pattern), words_joined(F.regexp_replace(t, pattern, F.lit("")))).otherwise(t)

        return _in_turn(text, named, near(full), exact(product), near(product), left_out, split, details, without_vendor)

    return _let(names, of_product)


def _in_turn(text: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps one after the other on a text: a fold, since steps within steps are too deep for the analyser."""

    def chosen(k: Column, values: list[Column], first: int) -> Column:
        half = len(values) // 2
        return F.when(k < first + half, chosen(k, values[:half], first)).otherwise(chosen(k, values[half:], first + half)) if half else values[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), text, lambda t, k: chosen(k, [step(t) for step in steps], 0))


def words_joined(text: Column) -> Column:
    """Words with one space between them."""
    return collapse_all(text)


def _label_once(text: Column, label: Column) -> Column:
    """Runs of a label become one, in a text whose words are joined."""

    def once(name: Column) -> Column:
        name = quoted(name)
        return F.regexp_replace(text, F.concat(F.lit("(?iU)("), name, F.lit(r"(?<=\b"), name, F.lit(r")\b)(?:" + REPEAT_GAP + r"\1)+")), F.lit("$1"))

    out = once(label)
    for name in lexicon.CPE_PARTS.values():  # a fixed pattern is made once
        out = F.when(label == name, once(F.lit(name))).otherwise(out)
    return out


def mask_products(text: Column, uris: Column) -> Column:
    """Product names in a text become the label of their part; texts without products are unchanged.

    The rules of the row's own products run one after the other over the text, as
    one fold of column expressions: the name, near spellings, single words, split
    words, target software, details, the vendor. Runs of the last product's label
    become one.
    """

    def masked(products: Column) -> Column:
        label = part_label(F.element_at(products, -1)[0][2])
        done = words_joined(F.aggregate(products, strip(F.lower(text)), _masked))
        once = _let(F.struct(done.alias("t"), label.alias("label")), lambda x: F.when(x["label"] == "", x["t"]).otherwise(_label_once(x["t"], x["label"])))
        return F.when(F.size(products) > 0, once).otherwise(text)

    return F.when(uris.isNull() | (F.size(uris) == 0), text).otherwise(_let(_products(uris), masked))
