"""Benchmark decontamination by size-partitioned MinHash containment (operator 10).

Items are short, documents may be very long, so signatures of documents are of no
use: the minima of a long text are hardly ever those of a short passage. Instead
the items are partitioned by the size of their sets, a class up to every power of two.
Each class has an index of its own, with the sketch length of its sizes: the smallest
hashes of an item, one more than a passage of the required containment can lack. A document with the containment must then hold a sketch hash, so the
search loses nothing. Candidates are verified by exact containment of the item's
shingles in the whole document.

Words are lower-cased (A-Z) and stripped of ASCII punctuation. The items' hashes
are sent to the tasks in blocks of at most ``BLOCK_SHINGLES``; a benchmark of any
size is searched block by block. Documents are mapped in place, without a shuffle.

Edge cases: null and empty texts match nothing; an item with fewer words than the
width is one shingle of all its words and found where a document has that run of
words; items without words never match; repeated rows are judged one by one; extra
columns are kept by :func:`flag` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrspark.llm.common import fresh
from corrspark.llm.shingles import Words, groups, hash_words, shingle_sets
from corrspark.session import materialise

WIDTH, PERCENT = 5, 80
#: Most item hashes that one block sends to every task (8 bytes each).
BLOCK_SHINGLES = 4_000_000


def class_of(n: int) -> int:
    """The largest size of the class that a set of ``n`` shingles is in."""
    return 1 << (n - 1).bit_length()


def _item_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in groups(batch.column(1)):
                words = hash_words(data, offsets, drop_punctuation=True)
                lengths = np.minimum(np.diff(words.starts), width)
                sets = shingle_sets(words, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(lengths, pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["item_id", "width", "shingles"])

    return run


class SizeClass(NamedTuple):
    """Items of one size class: their sketch hashes in order, and whose they are."""

    width: int
    largest: int
    sketch: int
    hashes: np.ndarray
    owners: np.ndarray

    def candidates(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """(text, item) where a text holds a sketch hash of the item."""
        flat = np.concatenate(sets)
        text_of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        low, high = np.searchsorted(self.hashes, flat, "left"), np.searchsorted(self.hashes, flat, "right")
        return sorted({(int(text_of[k]), int(i)) for k in np.flatnonzero(high > low) for i in self.owners[low[k]:high[k]]})


class Index:
    """Items of one block: full sets, and the size classes whose sketches lead to them."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], percent: int) -> None:
        self.ids = [r[0] for r in rows]
        self.sets = [np.sort(r[2]) for r in rows]
        self.percent = percent
        members: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, own) in enumerate(rows):
            members.setdefault((width, class_of(len(own))), []).append(i)
        self.classes = [self._build(width, largest, members[width, largest]) for width, largest in sorted(members)]

    def _build(self, width: int, largest: int, items: list[int]) -> SizeClass:
        sketch = self.sketch_length(largest)
        sketches = [self.sets[i][:sketch] for i in items]
        flat = np.concatenate(sketches)
        order = np.argsort(flat, kind="stable")
        return SizeClass(width, largest, sketch, flat[order], np.repeat(items, [len(s) for s in sketches])[order])

    def sketch_length(self, n: int) -> int:
        """One more than the most shingles that a match may lack, for the largest size of the class of ``n``."""
        largest = class_of(n)
        return largest - -(-largest * self.percent // 100) + 1

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, item shingles, shared shingles) of a group of texts."""
        width, sets = 0, []
        for part in self.classes:  # in order of width, so sets are made once for each
            if part.width != width:
                width = part.width
                sets = [s if b - a >= width else s[:0] for s, a, b in zip(shingle_sets(words, width), words.starts[:-1], words.starts[1:], strict=True)]
            for text, i in part.candidates(sets):
                item, own = self.sets[i], sets[text]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[at] == item).sum())
                if 100 * shared >= self.percent * len(item):
                    yield text, self.ids[i], len(item), shared


def _blocks(items: DataFrame, width: int) -> list[list[tuple[int, int, np.ndarray]]]:
    """Blocks of item sets whose size is known before they are read."""
    sets = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).mapInArrow(_item_sets(width), "item_id long, width int, shingles array<long>").where("width > 0"), "items")
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    count = -(-total // BLOCK_SHINGLES)
    for k in range(count):
        part = sets if count == 1 else sets.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k)
        yield [(r["item_id"], r["width"], np.array(r["shingles"], np.int64).view(np.uint64)) for r in part.toLocalIterator()]


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared`` for every document that holds an item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    out = None
    for rows in _blocks(items, width):
        index = Index(rows, percent)

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0), []
                for at, data, offsets in groups(batch.column(1)):
                    found += [(ids[at.start + m[0]].as_py(), *m[1:]) for m in index.matches(hash_words(data, offsets, drop_punctuation=True))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

        part = texts.mapInArrow(search, "doc_id long, item_id long, n_item_shingles long, n_shared long")
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item_shingles long, n_shared long") if out is None else out


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns and in their partitions."""
    for rows in _blocks(items, width):
        index = Index(rows, percent)
        text = fresh(docs, "_text")

        def drop(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, data, offsets in groups(batch.column(batch.num_columns - 1)):
                    for m in index.matches(hash_words(data, offsets, drop_punctuation=True)):
                        keep[at.start + m[0]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

        docs = docs.withColumn(text, F.col("text")).mapInArrow(drop, docs.schema)
    return docs


SQL = r"""
WITH norm AS (
  SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM norm),
s AS (SELECT DISTINCT kind, id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g
      FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared
FROM s i JOIN s d ON d.g = i.g AND d.kind = 'd' JOIN n ON n.id = i.id WHERE i.kind = 'i'
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""
