"""Phrase collocations from depth-truncated suffix subtrees (operator 11).

The suffixes of a text start at its words and end after ``DEPTH`` words or with
their piece. Vertical partitioning cuts their tree: the prefixes of one word are
dealt into bins by a hash and the suffixes of each bin counted; a bin with more than
a quarter of the memory budget has its prefixes extended by one word and counted
anew, until none is too large or the depth is reached. The bins that are left are
packed into groups that stay within the budget (largest first, to the emptiest
group). Every map task then sorts the suffixes of a block of texts, adds up equal
ones, and writes one run per group; the runs of a group build its subtrees
independently of all others. A node's count is the sum of the leaf totals below it.
A prefix that was extended is itself a leaf, at its own depth, of its bin's group.

What the driver holds and tasks get is bounded: totals and marks of ``BINS`` bins
per level. ``BUDGET`` caps the suffixes of a group (``GROUPS`` small groups where
there are few). A passage that is repeated everywhere is one entry per run.

Scores are whole numbers, computed with 38 digits. Phrases meet their parts by
joins that are salted on the parts' side.

Edge cases: null, empty and word-free texts add nothing; rows that repeat count
each; a null language is ``und``, together with rows that say so; equal scores go by
count, then by the phrase's bytes; an empty table gives no rows; other columns are
not read. Words are never cut, whatever their length; hashes only deal out work,
words are compared themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.shingles import mix64
from corrspark.llm.tokens import byte_class, runs, text_blocks
from corrspark.session import materialise

DEPTH, LEAST, PERCENT, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Most suffixes of a group, and how many groups are made even where fewer would do.
BUDGET, GROUPS, BINS = 4_000_000, 128, 1 << 17
BLOCK_ROWS, BLOCK_BYTES = 1 << 20, 4 << 20
#: Copies of a part that many phrases ask for.
SALTS = 8

_BREAK = byte_class([ord(c) for c in ".,;:!?"] + list(range(10, 14)))
_WORD = ~_BREAK
_WORD[[9, 32]] = False


class Suffixes:
    """Truncated suffixes of a block: a row per word, codes of its next words (0 where the piece has ended)."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        found = runs(data, offsets, _WORD)
        n = len(found.start)
        text = np.searchsorted(offsets, found.start, "right") - 1
        piece = np.concatenate((np.zeros(1, np.int32), np.cumsum(_BREAK[data], dtype=np.int32)))[found.start]
        new = np.ones(n + 1, bool)
        new[1:n] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
        cuts = np.flatnonzero(new)
        end = np.repeat(cuts[1:], np.diff(cuts)) if n else cuts[:0]
        codes = found.codes.astype(np.int32) + 1
        self.word = np.zeros((DEPTH, n), np.int32)
        for d in range(DEPTH):
            there = np.flatnonzero(np.arange(d, n + d) < end)
            self.word[d, there] = codes[there + d]
        lang = pc.fill_null(batch.column(0), "und").cast(pa.large_string()).dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int32)[text]
        self.terms = found.terms
        self._word_hash = np.array([0, *map(xxhash.xxh64_intdigest, self.terms.to_pylist())], np.uint64)
        self._hash = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)[self.lang]
        self._rows = np.arange(n)

    def bins(self, depth: int, rows: np.ndarray) -> np.ndarray:
        """Bins of the prefixes of some suffixes; called for one depth after the other, on ever fewer rows."""
        own = self._hash if len(rows) == len(self._hash) else self._hash[np.searchsorted(self._rows, rows)]
        self._hash = mix64(own * np.uint64(0x9E3779B97F4A7C15) + self._word_hash[self.word[depth - 1, rows]])
        self._rows = rows
        return (self._hash % np.uint64(BINS)).astype(np.int64)


def _count(large: list[np.ndarray]):
    """Suffixes per bin at the depth behind those whose large bins are known; at the first also per language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_lang: dict[str, int] = {}
        total = np.zeros(BINS, np.int64)
        for batch, data, offsets in text_blocks(batches, 1, BLOCK_ROWS, BLOCK_BYTES):
            s = Suffixes(batch, data, offsets)
            rows = np.arange(s.word.shape[1])
            for depth, marks in enumerate(large, 1):
                rows = rows[marks[s.bins(depth, rows)]]
                rows = rows[s.word[depth, rows] > 0]
            total += np.bincount(s.bins(len(large) + 1, rows), minlength=BINS)
            if not large:
                for lang, n in zip(s.langs.to_pylist(), np.bincount(s.lang, minlength=len(s.langs)).tolist(), strict=True):
                    per_lang[lang] = per_lang.get(lang, 0) + n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some])], names=["lang", "bin", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(per_lang), pa.string()), pa.nulls(len(per_lang), pa.int32()), pa.array(list(per_lang.values()), pa.int64())], names=["lang", "bin", "n"])

    return run


def _squeeze(columns: list[np.ndarray]) -> tuple[list[int], bytes]:
    """Columns of whole numbers in their least widths, compressed as one."""
    narrow = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    return [c.dtype.itemsize for c in narrow], pa.compress(b"".join(c.tobytes() for c in narrow), "zstd", asbytes=True)


def _unsqueeze(widths: list[int], data: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(data, n * sum(widths), "zstd", asbytes=True)
    ends = np.cumsum([0, *widths]) * n
    return [np.frombuffer(raw[a:b], f"u{w}").astype(np.int64) for a, b, w in zip(ends[:-1], ends[1:], widths, strict=True)]


def _squeeze_words(words: pa.Array) -> tuple[int, int, bytes]:
    """How many words, their bytes, and all lengths and bytes, compressed."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    text = words.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if len(words) else b""
    return len(words), len(text), pa.compress(np.diff(offsets).astype(np.uint32).tobytes() + text, "zstd", asbytes=True)


def _unsqueeze_words(n: int, size: int, data: bytes) -> pa.Array:
    raw = pa.decompress(data, 4 * n + size, "zstd", asbytes=True)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[4 * n:]))


_RUN = "grp int, n int, langs array<string>, n_words int, words_size int, words binary, widths array<int>, data binary"


def _runs(large: list[np.ndarray], group_of_bin: np.ndarray):
    """Per block and group the sorted distinct suffixes with their counts and the depth of the group's prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, 1, BLOCK_ROWS, BLOCK_BYTES):
            s = Suffixes(batch, data, offsets)
            if not s.word.shape[1]:
                continue
            base = len(s.terms) + 1
            by_word = pc.sort_indices(s.terms)  # neighbours in a run are alike, and small
            place = np.zeros(base, np.int32)
            place[by_word.to_numpy().astype(np.int64) + 1] = np.arange(1, base)
            sorted_terms = s.terms.take(by_word)
            rows = np.arange(s.word.shape[1])
            entries: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]] = []  # rows, groups, depth of prefix, words, counts
            for depth in range(1, len(large) + 2):
                bins = s.bins(depth, rows)
                to = group_of_bin[bins]
                more = large[depth - 1][bins] if depth <= len(large) else np.zeros(len(rows), bool)
                entries.append((rows[~more], to[~more], depth, DEPTH, np.ones(len(rows) - int(more.sum()), np.int64)))
                rows, to = rows[more], to[more]
                if not len(rows):
                    break
                number = s.lang[rows].astype(np.int64)
                for d in range(depth):
                    _, first, number = np.unique(number * base + s.word[d, rows], return_index=True, return_inverse=True)
                entries.append((rows[first], to[first], depth, depth, np.bincount(number)))
                rows = rows[s.word[depth, rows] > 0]
            at = np.concatenate([e[0] for e in entries])
            group = np.concatenate([e[1] for e in entries]).astype(np.int64)
            routed = np.concatenate([np.full(len(e[0]), e[2]) for e in entries])
            counts = np.concatenate([e[4] for e in entries])
            word = place[s.word[:, at]].astype(np.int64)
            reach = np.concatenate([np.full(len(e[0]), e[3]) for e in entries])
            for d in range(1, DEPTH):
                word[d, reach <= d] = 0
            lang = s.lang[at].astype(np.int64)
            _, head = np.unique((group * len(s.langs) + lang) * base + word[0], return_inverse=True)
            head, tail = head * base + word[1], word[2] * base + word[3]
            order = np.lexsort((tail, head))
            head, tail = head[order], tail[order]
            new = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))))
            counts = np.add.reduceat(counts[order], new)
            kept = order[new]
            group, routed, word, lang = group[kept], routed[kept], word[:, kept], lang[kept]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ends = np.append(starts[1:], len(group))
            widths, packed, words = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own = word[:, a:b]
                seen = np.zeros(base, bool)
                seen[own] = True
                seen[0] = False
                used = np.flatnonzero(seen)
                place[used] = np.arange(1, len(used) + 1)
                w, d = _squeeze([lang[a:b], *place[own], counts[a:b], routed[a:b]])
                widths.append(w)
                packed.append(d)
                words.append(_squeeze_words(sorted_terms.take(pa.array(used - 1))))
            yield pa.RecordBatch.from_arrays([
                pa.array(group[starts], pa.int32()), pa.array(ends - starts, pa.int32()),
                pa.array([s.langs.to_pylist()] * len(starts), pa.list_(pa.string())),
                *(pa.array(c, t) for c, t in zip(zip(*words, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)),
                pa.array(widths, pa.list_(pa.int32())), pa.array(packed, pa.binary()),
            ], names=["grp", "n", "langs", "n_words", "words_size", "words", "widths", "data"])

    return run


_NODES = "lang string, phrase string, k int, f long"


def _subtrees(least: int):
    """The nodes of a group's subtrees with at least so many suffixes below them."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        lists = [_unsqueeze_words(*w) for w in zip(*(table[name].to_pylist() for name in ("n_words", "words_size", "words")), strict=True)]
        listed = [pa.concat_arrays([c.flatten() for c in table["langs"].chunks]).dictionary_encode(), pa.concat_arrays(lists).dictionary_encode()]
        lengths = [pc.list_value_length(table["langs"]).to_pylist(), [len(x) for x in lists]]
        ids = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in listed]
        columns: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 3)]
        at = [0, 0]
        for n, n_langs, n_words, widths, data in zip(sizes, *lengths, table["widths"].to_pylist(), table["data"].to_pylist(), strict=True):
            lang_of = ids[0][at[0]:at[0] + n_langs]
            word_of = np.concatenate((np.zeros(1, np.int64), ids[1][at[1]:at[1] + n_words] + 1))
            at = [at[0] + n_langs, at[1] + n_words]
            values = _unsqueeze(widths, data, n)
            for column, v in zip(columns, (lang_of[values[0]], *(word_of[w] for w in values[1:DEPTH + 1]), *values[DEPTH + 1:]), strict=True):
                column.append(v)
        lang, *words, counts, routed = (np.concatenate(c) for c in columns)
        terms = listed[1].dictionary
        base = len(terms) + 1
        _, head = np.unique(lang * base + words[0], return_inverse=True)
        order = np.lexsort((words[2] * base + words[3], head * base + words[1]))
        lang, counts, routed, words = lang[order], counts[order], routed[order], [w[order] for w in words]
        new = np.concatenate(([True], (lang[1:] != lang[:-1]))) if len(lang) else np.zeros(0, bool)
        out = []
        for d in range(DEPTH):
            new = new.copy()
            new[1:] |= words[d][1:] != words[d][:-1]
            start = np.flatnonzero(new)
            total = np.add.reduceat(np.where(routed <= d + 1, counts, 0), start)  # those of longer prefixes are counted by their own
            keep = (total >= least) & (words[d][start] > 0)
            at_node = start[keep]
            parts_of = [terms.take(pa.array(words[j][at_node] - 1)).cast(pa.string()) for j in range(d + 1)]
            phrase = pc.binary_join_element_wise(*parts_of, " ") if d else parts_of[0]
            out.append(pa.table({
                "lang": listed[0].dictionary.take(pa.array(lang[at_node])).cast(pa.string()), "phrase": phrase,
                "k": pa.array(np.full(len(at_node), d + 1, np.int32)), "f": pa.array(total[keep])}))
        return pa.concat_tables(out)

    return run


def pack(totals: dict[int, int], groups: int) -> np.ndarray:
    """Bins to groups: the largest first, each to the group with the least so far."""
    out = np.arange(BINS, dtype=np.int32) % groups
    heap = [(0, g) for g in range(groups)]
    for b, n in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        load, g = heapq.heappop(heap)
        out[b] = g
        heapq.heappush(heap, (load + n, g))
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of up to ``DEPTH`` words found ``least`` times, and ``lang, n`` (all words)."""
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def counted(large: list[np.ndarray]) -> DataFrame:
        rows = texts.mapInArrow(_count(large), "lang string, bin int, n long")
        return materialise(rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "prefixes")

    first = level = counted([])
    total = first.where("bin is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(1, min(budget, -(-total // groups)))
    limit = max(1, size // 4)
    large: list[np.ndarray] = []
    totals: dict[int, int] = {}
    while True:
        of_bin = {r["bin"]: r["n"] for r in level.where("bin is not null").toLocalIterator()}  # at most BINS
        over = [b for b, n in of_bin.items() if n > limit] if len(large) < DEPTH - 1 else []
        for b in of_bin.keys() - set(over):
            totals[b] = totals.get(b, 0) + of_bin[b]
        if not over:
            break
        marks = np.zeros(BINS, bool)
        marks[over] = True
        large.append(marks)
        level = counted(large)
    dealt = texts.mapInArrow(_runs(large, pack(totals, max(1, -(-total // max(1, size - limit))))), _RUN)
    nodes = dealt.groupBy("grp").applyInArrow(_subtrees(least), _NODES)
    return materialise(nodes, "nodes"), first.where("bin is null").select("lang", "n")


def _join(words, a, n):
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, budget: int = BUDGET, groups: int = GROUPS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first phrases of every language."""
    nodes, sums = phrase_counts(docs, least, budget, groups)
    found = nodes.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = found.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _join(F.col("words"), F.lit(1), F.col("cut")).alias("first"), _join(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
        F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    parts = nodes.where(F.col("k") < DEPTH).select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    left = parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"), "salt")
    right = parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"), "salt")
    scored = cuts.join(left, ["lang", "first", "salt"]).join(right, ["lang", "rest", "salt"])
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(12,0)) * CAST(a AS DECIMAL(20,0)) div CAST(l + r AS DECIMAL(20,0)) AS LONG)")
    best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _join(F.col("words"), i, n))))
    inside = found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < percent * F.col("a").cast("decimal(20,0)")))
    rows = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest(range(1, {DEPTH + 1})) AS k FROM w) WHERE len(ws) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
s AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
u AS (SELECT *, unnest(range(1, k)) AS j FROM c),
v AS (SELECT u.lang, u.phrase, u.a, u.j, x.f AS l, y.f AS r, CAST({SCALE}::HUGEINT * u.a // (x.f + y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:u.j], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[u.j + 1:], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
      FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
x AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {PERCENT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN s USING (lang)
QUALIFY rank <= {TOP}
"""
