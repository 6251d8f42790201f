"""Keyword scoring of texts against pattern names and alternate terms.

One pass per text finds every keyword at once: exact containment, containment
after stop words, lemmas and stems, shared words, shared runs and halves. Work
per text follows its length and its hits, not the number of keywords.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corrspark import lexicon
from corrspark.functions import words as W
from corrspark.functions.pieces import map_pieces
from corrspark.functions.text import uniform_string
from corrspark.operators.blocks import BROADCAST_LIMIT, ROW, catalogue_blocks, map_blocks, numbered, text_bytes

try:
    import ahocorasick
except ImportError:  # plain substring tests give the same answer
    ahocorasick = None


class Acronyms:
    """Replaces acronyms by expansions, then expansions by acronyms, in list order."""

    def __init__(self, table: dict[str, list[str]]):
        def pattern(text: str) -> re.Pattern:
            return re.compile(rf"\b{text}\b", re.IGNORECASE)

        self.spell_out, self.shorten = [], []
        for acronym, expansions in table.items():
            for full in expansions:
                a, e = re.escape(acronym), re.escape(full)
                self.spell_out.append((acronym.lower(), pattern(rf"{e}\s+{a}"), pattern(a), full))
                self.shorten.append((full.lower(), pattern(e), acronym))
        self.hints = [hint for hint, *_ in self.spell_out + self.shorten]
        self.find = Finder([(hint, k) for k, hint in enumerate(self.hints) if hint])

    def __call__(self, text: str) -> str:
        low = text.lower()
        if not any(k >= len(self.spell_out) or self._may_stand(self.hints[k], low) for k in self.find(low)):
            return text  # the common case: one pass finds nothing to replace
        for hint, both, alone, full in self.spell_out:
            if hint in low and self._may_stand(hint, low):  # cheap tests before the two substitutions
                text = alone.sub(lambda _: full, both.sub(lambda _: full, text))
                low = text.lower()
        for hint, full, acronym in self.shorten:
            if hint in low:
                text = full.sub(acronym, text)
                low = text.lower()
        return text


    @staticmethod
    def _may_stand(hint: str, low: str) -> bool:
        """Whether an acronym can stand as a word, not only inside of words."""
        if not (low.isascii() and hint.isascii() and hint.isalnum()):
            return True
        at = low.find(hint)
        while at >= 0:
            end = at + len(hint)
            if not (at and _in_word(low[at - 1]) or end < len(low) and _in_word(low[end])):
                return True
            at = low.find(hint, at + 1)
        return False


def _in_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


class Finder:
    """All needles contained in a text; several needles may be equal."""

    def __init__(self, needles: list[tuple[str, int]]):
        self.owners = defaultdict(set)
        for text, owner in needles:
            self.owners[text].add(owner)
        self.automaton = None
        if ahocorasick is not None and self.owners:
            self.automaton = ahocorasick.Automaton()
            for text in self.owners:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()

    def __call__(self, text: str) -> set[int]:
        if self.automaton is not None:
            found = {needle for _, needle in self.automaton.iter(text)}
        else:
            found = {needle for needle in self.owners if needle in text}
        return set().union(*(self.owners[n] for n in found)) if found else set()


#: Parts of texts that a task remembers with their stems, at most (but for those of one text): some 50 MB.
KNOWN_PARTS = 1 << 18


class _Stems(dict):
    """Content stems of the parts of a text between blanks, each worked out once."""

    def __init__(self, stop: frozenset, lemma, stem):
        super().__init__()
        self.stop, self.lemma, self.stem = stop, lemma, stem

    def __reduce__(self):  # tasks begin with none
        return _Stems, (self.stop, self.lemma, self.stem)

    def __missing__(self, part: str) -> tuple[str, ...]:
        tokens = [] if part.lower() in self.stop else W.tokens(part)
        lemmas = tokens if self.lemma is None else [self.lemma(t) for t in tokens]
        self[part] = out = tuple(t.lower() if self.stem is None else self.stem(t) for t in lemmas)
        return out


class Normaliser:
    """Text to its compared form: (lower-cased text, content stems)."""

    def __init__(self, stopwords, acronyms, lemma, stem, stems: bool = True):
        self.stop, self.acronyms = frozenset(stopwords), Acronyms(acronyms)
        self.known, self.stems = _Stems(self.stop, lemma, stem), stems

    def __call__(self, uniform: str) -> tuple[str, list[str]]:
        text = self.acronyms(uniform)
        if not self.stems:
            return text.lower(), []
        known = self.known
        if len(known) > KNOWN_PARTS:
            known.clear()
        # no token reaches over a blank
        return text.lower(), [s for part in text.split() for s in known[part]]


class KeywordIndex:
    """A keyword catalogue laid out for one pass per text (lives inside a task)."""

    def __init__(self, rows: pd.DataFrame, normalise: Normaliser, stages: tuple[str, ...], compat: bool):
        self.normalise, self.stages = normalise, stages
        self.patterns = sorted(rows["capec_id"].unique())
        self.width = len(self.patterns)
        place = {p: i for i, p in enumerate(self.patterns)}
        self.owner = rows["capec_id"].map(place).to_numpy()
        forms = [normalise(u) for u in rows["uniform"]]
        self.stems = [stems for _, stems in forms]
        usable = lambda text: text != "" or compat
        self.always = {k for k, (text, stems) in enumerate(forms) if compat and (not text or not stems)}
        self.exact = Finder([(text, k) for k, (text, _) in enumerate(forms) if text])
        self.stemmed = Finder([(" ".join(s), k) for k, s in enumerate(self.stems) if s and usable(" ".join(s))])
        self.halves = Finder([
            (" ".join(half), k)
            for k, s in enumerate(self.stems) if len(s) >= 4
            for half in (s[: len(s) // 2], s[len(s) // 2 :])
        ])
        self.by_word, self.by_pair = defaultdict(list), defaultdict(list)
        for k, stems in enumerate(self.stems):
            for word in stems:
                self.by_word[word].append(k)
            for i, pair in enumerate(zip(stems, stems[1:])):
                self.by_pair[pair].append((k, i))

    def scores(self, uniform: str) -> dict[int, float]:
        """Score per keyword; keywords that score nothing are left out."""
        return self.form_scores(*self.normalise(uniform))

    def form_scores(self, text: str, stems: list[str]) -> dict[int, float]:
        """The same of a text in its compared form."""
        best = dict.fromkeys(self.always, lexicon.KEYWORD_MAX)
        if "exact" in self.stages:
            best.update(dict.fromkeys(self.exact(text), lexicon.KEYWORD_MAX))
        joined = " ".join(stems)
        if "stemmed" in self.stages:
            best.update(dict.fromkeys(self.stemmed(joined), lexicon.KEYWORD_MAX))
        if "partial" in self.stages:
            for k, score in self._partial(stems, joined).items():
                best.setdefault(k, score)
        return best

    def _partial(self, stems: list[str], joined: str) -> dict[int, float]:
        found = defaultdict(int)
        for word in set(stems):
            for k in self.by_word.get(word, ()):
                found[k] += 1
        shared = defaultdict(set)
        for pair in set(zip(stems, stems[1:])):
            for k, i in self.by_pair.get(pair, ()):
                shared[k].add(i)
        halves = self.halves(joined)
        delimited = f" {joined} "
        scores = {}
        for k in found.keys() | halves:
            n = len(self.stems[k])
            run = self._longest_run(k, shared[k], delimited) if k in shared else 1
            score = lexicon.KEYWORD_PARTIAL_MAX / n * found[k]
            # the j-th further word of a run adds j/n of the bonus, capped
            score += min(lexicon.KEYWORD_RUN_BONUS, lexicon.KEYWORD_RUN_BONUS / n * run * (run - 1) / 2)
            if k in halves:
                score += lexicon.KEYWORD_HALF_BONUS
            elif found[k] >= 2:
                score += lexicon.KEYWORD_PAIR_BONUS
            scores[k] = score
        return scores

    def _longest_run(self, k: int, pairs: set[int], delimited: str) -> int:
        """Words in the longest keyword run that the text repeats.

        Shared word pairs bound the runs; only chains of them are looked up.
        """
        stems, best = self.stems[k], 2 if pairs else 1
        chains, start = [], None
        for i in range(len(stems)):
            if i in pairs:
                start = i if start is None else start
            elif start is not None:
                chains.append((start, i + 1))
                start = None
        for first, last in chains:
            for i in range(first, last):
                while i + best + 1 <= last and f" {' '.join(stems[i : i + best + 1])} " in delimited:
                    best += 1
        return best

    def by_pattern(self, text: str, stems: list[str]) -> np.ndarray:
        """Best keyword score per pattern of a compared form, in thousandths (zero: no hit)."""
        best = np.zeros(len(self.patterns), dtype=np.int64)
        for k, score in self.form_scores(text, stems).items():
            place = self.owner[k]
            best[place] = max(best[place], int(score * 1000 + 0.5))
        return best


STAGES = ("exact", "stemmed", "partial")


def _options(stages, stopwords, acronyms, lemma, stem, compat):
    normalise = Normaliser(stopwords, acronyms, lemma, stem, stems=set(stages) != {"exact"} or compat)
    return normalise, lambda rows: KeywordIndex(rows, normalise, stages, compat)


# between the stems of a stored form: a blank, which no token holds
BETWEEN = "\x1f"
FORM = pa.struct([("text", pa.string()), ("stems", pa.string())])


def _compared(uniform: Column, normalise: Normaliser) -> Column:
    """The compared form of a text, which every block of keywords is held against; no stems are null."""

    def form(own: str) -> dict[str, str | None]:
        text, stems = normalise(own)
        return {"text": text, "stems": BETWEEN.join(stems) if stems else None}

    @F.arrow_udf("struct<text: string, stems: string>")
    def run(texts: pa.Array) -> pa.Array:
        return map_pieces(texts, form, FORM)

    return run(uniform)


def _sides(texts: DataFrame, keywords: DataFrame, key: str, text: str, keep: list[str]):
    left = texts.select(key, *keep, uniform_string(F.col(text)).alias("_uniform"))
    valid = keywords.filter(F.col("keyword").isNotNull() & (F.col("keyword") != ""))
    right = valid.select("capec_id", uniform_string(F.col("keyword")).alias("uniform"))
    return left, right


def keyword_hits(
    texts: DataFrame,
    keywords: DataFrame,
    key: str = "cve_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    stages: tuple[str, ...] = STAGES,
    stopwords=lexicon.STOPWORDS,
    acronyms=None,
    lemma=W.noun_lemma,
    stem=W.stem,
    compat: bool = False,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Each text with ``hits``: array<struct<capec_id, score>> of its patterns.

    ``keywords`` has (capec_id, keyword). Patterns that are not listed have no
    hit; callers give them the malus. Columns in ``keep`` ride along.
    """
    left, right = _sides(texts, keywords, key, text, list(keep))
    normalise, prepare = _options(stages, stopwords, lexicon.ACRONYMS if acronyms is None else acronyms, lemma, stem, compat)
    types = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    extra = "".join(f", {c} {types[c]}" for c in keep)

    def find(batch: pa.RecordBatch, index: KeywordIndex) -> pa.RecordBatch:
        place, score, ends = [], [], [0]
        for value in batch.column("_uniform"):  # one text at a time
            if value.is_valid:
                own = value.as_py()
                form = normalise(own) if isinstance(own, str) else (own["text"], own["stems"].split(BETWEEN) if own["stems"] is not None else [])
                best = index.by_pattern(*form)
                found = np.flatnonzero(best)
                place.append(found)
                score.append(best[found])
            ends.append(ends[-1] + (len(place[-1]) if value.is_valid else 0))
        places = np.concatenate(place) if place else np.zeros(0, np.int64)
        scores = np.concatenate(score) / 1000 if score else np.zeros(0)
        ids = pa.array(index.patterns, pa.string()).take(pa.array(places))
        hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([ids, pa.array(scores)], ["capec_id", "score"]))
        kept = [n for n in batch.schema.names if n != "_uniform"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), hits], names=[*kept, "hits"])

    schema = f"{key} {types[key]}{extra}, hits array<struct<capec_id: string, score: double>>"
    blocks = catalogue_blocks(right, text_bytes(F.col("uniform")), "capec_id", limit)
    if len(blocks) == 1:
        return map_blocks(left, blocks, prepare, find, schema, arrow=True)
    # texts are brought into their compared form once for all blocks
    left = left.withColumn("_uniform", _compared(F.col("_uniform"), normalise))
    # every block gives one list per text; a text keeps its number, so equal keys stay apart
    rows = map_blocks(numbered(left), blocks, prepare, find, f"{key} {types[key]}{extra}, {ROW} long, hits array<struct<capec_id: string, score: double>>", arrow=True)
    first = [F.first(c).alias(c) for c in (key, *keep)]
    return rows.groupBy(ROW).agg(*first, F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).drop(ROW)


def keyword_scores(texts: DataFrame, keywords: DataFrame, key: str = "cve_id", text: str = "text", limit: int = BROADCAST_LIMIT, **options) -> DataFrame:
    """(key, capec_id, keyword_score) of every text and pattern; no hit is the malus."""
    hits = keyword_hits(texts, keywords, key, text, limit=limit, **options)
    patterns = keywords.select("capec_id").distinct()
    key_type = texts.schema[key].dataType.simpleString()

    def spread(batch: pa.RecordBatch, ids: list[str]) -> pa.RecordBatch:
        scores = np.full(batch.num_rows * len(ids), -lexicon.KEYWORD_MALUS)
        hits, names = batch.column("hits"), pa.array(ids, pa.string())
        flat = hits.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(hits), 0)))
        place = pc.fill_null(pc.index_in(flat.field("capec_id"), names), -1).to_numpy()
        known = place >= 0  # the others are patterns of another block
        scores[row[known] * len(ids) + place[known]] = flat.field("score").to_numpy(zero_copy_only=False)[known]
        rows = pa.array(np.repeat(np.arange(batch.num_rows), len(ids)))
        cells = pa.array(np.tile(np.arange(len(ids)), batch.num_rows))
        return pa.RecordBatch.from_arrays([batch.column(key).take(rows), names.take(cells), pa.array(scores)], names=[key, "capec_id", "keyword_score"])

    blocks = catalogue_blocks(patterns, text_bytes(F.col("capec_id")), "capec_id", limit)
    return map_blocks(hits, blocks, lambda p: sorted(p["capec_id"]), spread, f"{key} {key_type}, capec_id string, keyword_score double", arrow=True)


def exact_pairs(texts: DataFrame, keywords: DataFrame, key: str, text: str, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(key, capec_id): patterns with a keyword contained in the text, spelling aside."""
    found = keyword_hits(texts, keywords, key, text, stages=("exact",), acronyms={}, limit=limit)
    return found.select(key, F.explode("hits").alias("h")).select(key, F.col("h.capec_id").alias("capec_id"))


def fuzzy_title_score(title: str, text: str, stem=W.stem, threshold: int = 80) -> float:
    """Similarity of a title to a text by exact and near words (one pair)."""
    if title.lower() in text.lower():
        return lexicon.KEYWORD_MAX
    names, body = ([stem(t) for t in W.tokens(x.lower())] for x in (title, text))
    if not names or not body:
        return 0.0
    pool, n = set(body), len(names)
    by_length = defaultdict(list)
    for b in pool:
        by_length[len(b)].append(b)

    def has_near(name: str) -> bool:
        size = len(name)
        # a ratio is at most that of the lengths
        fitting = (bs for k, bs in by_length.items() if size + k == 0 or round(200 * min(size, k) / (size + k)) > threshold)
        return any(W.ratio(name, b) > threshold for bs in fitting for b in bs)

    hit = [name in pool for name in names]
    near = [not h and has_near(name) for h, name in zip(hit, names)]
    score = sum(hit) * lexicon.KEYWORD_MAX / n + sum(near) * lexicon.KEYWORD_HALF_BONUS / n
    share = sum(hit) / n
    return score + (0.1 if 0.5 <= share < 0.75 else 0.05 if 0.25 <= share < 0.5 else 0.0)


def fuzzy_title_scores(pairs: DataFrame, title: str, text: str, out: str = "score") -> DataFrame:
    """Score of two text columns of the same row."""

    @F.pandas_udf("double")
    def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([fuzzy_title_score(a, b) for a, b in zip(titles, texts)], dtype=float)

    return pairs.withColumn(out, run(F.col(title), F.col(text)))
