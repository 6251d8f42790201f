"""Ranked lexical search over a K2-treap of the term-document grid (operator 13).

The grid has a row per term, a column per document, and an impact in every cell
whose document holds the term. Documents are dealt into blocks; the grid of a block
is a quadtree that is stored level by level: a mask of the four quarters of every
non-empty square, and how far its largest impact lies below that of the square
around it. Columns are in order of the document ids, rows in order of the terms.

An item descends along the paths of all its rows at once: a range of documents is
worth the sum of its terms' weights times the largest impacts of the squares where
the rows cross the range, and no document in it can score more. Ranges are halved
best first, a batch at a time, until none can reach the first k; equal scores go by
document id, which a range's first column bounds. So the result is exact.

Rows are found by comparing the terms themselves. The whole corpus is indexed; items
come in blocks of at most ``ITEM_BYTES`` of terms, one block after the other, and
only such a block is ever sent to the tasks.

Edge cases: null, empty and term-free texts are no documents and no queries; every
row of either table counts by itself, also where ids repeat; equal scores of one id
stand in any order (their rows are equal); null document ids come after all others;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.tokens import byte_class, runs, text_blocks
from corrspark.session import materialise

#: Documents and bytes of text of one block of the grid.
BLOCK_ROWS, BLOCK_BYTES = 3072, 8 << 20
#: Results per item, ranges halved at a time, and most bytes of terms sent to the tasks at once.
TOP, BATCH, ITEM_BYTES = 50, 96, 16 << 20
#: Bytes of a term: letters and digits of ASCII, and all of other characters.
INSIDE = byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ONES = np.array([bin(m).count("1") for m in range(16)], np.uint8)


def terms_of(text: Column) -> Column:
    """Distinct terms of a text; no text has none."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in text_blocks(batches, 0, 1 << 30, BLOCK_BYTES):
        wanted = INSIDE[data]
        first = wanted.copy()
        first[1:] &= ~wanted[:-1]
        cuts = offsets[offsets < len(data)]
        first[cuts] = wanted[cuts]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(first)))
        per_text = np.diff(sums[offsets])
        yield pa.RecordBatch.from_arrays([pa.array([int((per_text > 0).sum())]), pa.array([int(per_text.sum())])], names=["texts", "terms"])


# --- the tree --------------------------------------------------------------


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Bit i of a 32-bit number moves to bit 2 i."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def squares(row: np.ndarray, col: np.ndarray, impact: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Masks of the squares with cells and their largest impacts, by level from the whole grid down."""
    code = (_spread_bits(row) << np.uint64(1)) | _spread_bits(col)
    order = np.argsort(code)
    code, top = code[order], impact[order]
    masks, tops = [], [top]
    for _ in range(height):
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.uint8)).astype(np.uint8), first))
        top = np.maximum.reduceat(top, first)
        tops.append(top)
        code = parent[first]
    return masks[::-1], tops[::-1]


def packed(masks: list[np.ndarray], tops: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Masks, and impacts as what a square lacks to the one around it."""
    below = [tops[0], *(np.repeat(tops[k], _ONES[m]) - tops[k + 1] for k, m in enumerate(masks))]
    squeeze = lambda parts, kind: pa.compress(np.concatenate(parts).astype(kind).tobytes(), "zstd", asbytes=True)
    return (squeeze(masks, np.uint8) if masks else b""), squeeze(below, np.uint32)


class Treap:
    """A block's tree, ready to descend: per square its mask, first child and largest impact."""

    def __init__(self, sizes: list[int], masks: bytes, below: bytes) -> None:
        self.height = len(sizes) - 1
        inner, every = sum(sizes[:-1]), sum(sizes)
        unpack = lambda raw, kind, n: np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)
        # one square behind the last stands for "no cell"
        self.mask = np.zeros(every + 1, np.uint8)
        if inner:
            self.mask[:inner] = unpack(masks, np.uint8, inner)
        ones = _ONES[self.mask]
        self.first = np.ones(every + 1, np.int32)
        np.cumsum(ones[:-1], dtype=np.int32, out=self.first[1:])
        self.first[1:] += 1
        self.top = np.zeros(every + 1, np.int32)
        lacks = unpack(below, np.uint32, every)
        self.top[0] = lacks[0]
        a = 0
        for n, m in zip(sizes[:-1], sizes[1:], strict=True):
            b = a + n
            self.top[b:b + m] = np.repeat(self.top[a:b], ones[a:b]) - lacks[b:b + m]
            a = b
        self.none = every

    def child(self, squares: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.mask[squares]
        at = self.first[squares] + _ONES[mask & ((1 << quarter) - 1)]
        return np.where((mask >> quarter) & 1 == 1, at, self.none)


class Best:
    """The first k documents of one item so far, by score and id (null ids last)."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.null = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate((self.score, score)), np.concatenate((self.id, doc)), np.concatenate((self.null, null))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.id, self.null = score[order], doc[order], null[order]

    def hopeless(self, bound: np.ndarray, doc: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Ranges that can't hold a document before the last one kept."""
        if len(self.score) < self.k:
            return np.zeros(len(bound), bool)
        last, last_doc, last_null = self.score[-1], self.id[-1], self.null[-1]
        later = (null & ~last_null) | ((null == last_null) & (doc > last_doc))
        return (bound < last) | ((bound == last) & later)


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, null: np.ndarray, best: Best, batch: int = BATCH) -> None:
    """Add to ``best`` what a block holds for the terms in ``rows``."""
    height, columns = treap.height, max(1, (len(docs) - 1).bit_length())
    square = np.zeros(len(rows), np.int64)
    level = 0
    while height - level > columns:  # above the columns only the rows are halved
        square = treap.child(square, (rows >> (height - 1 - level) & 1) * 2)
        level += 1
    levels, firsts, nodes = np.array([level]), np.zeros(1, np.int64), square[None, :]
    bounds = treap.top[nodes] @ weights
    while len(bounds):
        ready = levels == height
        if ready.any():
            best.add(bounds[ready], docs[firsts[ready]], null[firsts[ready]])
        open_ = ~ready & ~best.hopeless(bounds, docs[firsts], null[firsts])
        levels, firsts, nodes, bounds = levels[open_], firsts[open_], nodes[open_], bounds[open_]
        if not len(bounds):
            break
        if len(bounds) > batch:
            chosen = np.zeros(len(bounds), bool)
            chosen[np.argpartition(-bounds, batch - 1)[:batch]] = True
        else:
            chosen = np.ones(len(bounds), bool)
        lv, at = levels[chosen], nodes[chosen]
        shift = height - 1 - lv
        quarter = (rows[None, :] >> shift[:, None] & 1) * 2
        halves = [treap.child(at, quarter), treap.child(at, quarter + 1)]
        new = np.concatenate(halves)
        new_first = np.concatenate((firsts[chosen], firsts[chosen] + (1 << shift)))
        new_bound = treap.top[new] @ weights
        filled = new_bound > 0
        left = ~chosen
        levels = np.concatenate((levels[left], np.concatenate((lv + 1, lv + 1))[filled]))
        firsts = np.concatenate((firsts[left], new_first[filled]))
        nodes = np.concatenate((nodes[left], new[filled]))
        bounds = np.concatenate((bounds[left], new_bound[filled]))


# --- jobs ------------------------------------------------------------------

_INDEX = "doc_ids array<long>, terms array<string>, held array<int>, sizes array<int>, masks binary, below binary"


def _build(n_texts: int, n_terms: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, 1, rows, size):
            found = runs(data, offsets, INSIDE)
            if not len(found.start):
                continue
            by_id = pc.sort_indices(batch.column(0)).to_numpy()  # nulls last
            column = np.empty(len(by_id), np.int64)
            column[by_id] = np.arange(len(by_id))
            col = column[np.searchsorted(offsets, found.start, "right") - 1]
            by_term = pc.sort_indices(found.terms).to_numpy()
            place = np.empty(len(by_term), np.int64)
            place[by_term] = np.arange(len(by_term))
            width = len(by_id)
            cells, tf = np.unique(place[found.codes] * width + col, return_counts=True)
            row, col_of = cells // width, cells % width
            length = np.bincount(col, minlength=width)
            m = 50 + 50 * length * n_texts // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[col_of])
            height = max(1, (len(by_term) - 1).bit_length(), (width - 1).bit_length())
            masks, tops = squares(row, col_of, impact, height)
            packed_masks, below = packed(masks, tops)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0).take(pa.array(by_id))], pa.list_(pa.int64())),
                pa.array([found.terms.take(pa.array(by_term))], pa.list_(pa.large_string())).cast(pa.list_(pa.string())),
                pa.array([np.bincount(row, minlength=len(by_term)).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([[len(t) for t in tops]], pa.list_(pa.int32())),
                pa.array([packed_masks], pa.binary()), pa.array([below], pa.binary()),
            ], names=["doc_ids", "terms", "held", "sizes", "masks", "below"])

    return run


def index(docs: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The written blocks of the grid of all documents, and the number of documents with terms."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n_texts, n_terms = texts.select("text").mapInArrow(_count, "texts long, terms long").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return materialise(texts.mapInArrow(_build(n_texts, max(1, n_terms), rows, size), _INDEX), "treap"), n_texts


def _held(asked: pa.Array):
    """How many documents hold the asked terms, by their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(asked, value_set=batch.column(0)[k].values)
                there = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                total[there] += batch.column(1)[k].values.to_numpy()[at.take(pa.array(there)).to_numpy()]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["place", "df"])

    return run


def _search(asked: pa.Array, weights: np.ndarray, items: list[tuple[int, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, terms, sizes, masks, below = (batch.column(c)[i] for c in range(5))
                ids = doc_ids.values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                docs = pc.fill_null(ids, 0).to_numpy()
                treap = Treap(sizes.as_py(), masks.as_py(), below.as_py())
                row_of = pc.fill_null(pc.index_in(asked, value_set=terms.values), -1).to_numpy().astype(np.int64)
                for own, (_, places) in zip(best, items, strict=True):
                    there = places[row_of[places] >= 0]
                    if len(there):
                        descend(treap, row_of[there], weights[there], docs, null, own)
        for own, (key, _) in zip(best, items, strict=True):
            if len(own.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own.score), key)), pa.array(own.id, mask=own.null), pa.array(own.score)], names=["_key", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the first ``top`` documents of every item."""
    treaps, n_texts = index(docs, rows, size)
    asked = materialise(
        items.select("item_id", terms_of(F.col("text")).alias("terms")).where(F.size("terms") > 0)
        .withColumn("_key", F.monotonically_increasing_id()), "items")
    cost = F.aggregate("terms", F.lit(0).cast("long"), lambda total, t: total + F.octet_length(t) + 40)
    blocks = -(-asked.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0] // item_bytes)
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b)
        rows_of = part.select("_key", "terms").toArrow()  # one block: its size is bounded
        terms = pa.concat_arrays([c.values for c in rows_of["terms"].chunks]).dictionary_encode() if rows_of.num_rows else None
        if terms is None:
            continue
        codes, words = terms.indices.to_numpy(), terms.dictionary
        lengths = pc.list_value_length(rows_of["terms"]).to_numpy()
        ends = np.cumsum(lengths)
        own = [(key, codes[e - n:e].astype(np.int64)) for key, n, e in zip(rows_of["_key"].to_pylist(), lengths, ends, strict=True)]
        held = treaps.select("terms", "held").mapInArrow(_held(words), "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
        weighed = held.select("place", F.floor(1000 * F.log((F.lit(2.0) * n_texts + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long").alias("w")).toArrow()
        weights = np.zeros(len(words), np.int64)
        weights[weighed["place"].to_numpy()] = weighed["w"].to_numpy()
        hits = treaps.select("doc_ids", "terms", "sizes", "masks", "below").mapInArrow(_search(words, weights, own, top), "_key long, doc_id long, score long")
        part_found = materialise(hits, "hits")
        found = part_found if found is None else found.union(part_found)
    if found is None:
        return asked.where(F.lit(False)).select("item_id", F.lit(0).alias("rank"), F.col("_key").alias("doc_id"), F.col("_key").alias("score"))
    order = Window.partitionBy("_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("_key", "item_id"), "_key").select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS ws FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(len(ws)), 0) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
i AS (SELECT row_number() OVER () AS k, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS ts FROM benchmark),
q AS (SELECT k, item_id, unnest(ts) AS t FROM i),
o AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM o WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, n_docs),
s AS (SELECT k, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN w USING (t), c GROUP BY k, r),
g AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM g WHERE rank <= {TOP}
"""
