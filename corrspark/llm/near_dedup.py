"""MinHash near-duplicates with circulant signatures (operator 9).

Signatures: one permutation places every shingle on a circle of 2 ** 32 points, a
second one, shifted by one point per coordinate, ranks the points; a coordinate is
the smallest rank. Coordinates are banded; texts that share a band are compared on
their full sets, and only confirmed links count.

No pairs within a group are listed. Texts with equal sets are one class from the
start. In every band the members are compared with ``PIVOTS`` of them only: first
the one that shares most bands with others (in a group of edited copies, the text
that is closest to all), then others by a hash. Links make components. What a band
still holds of different components is settled by counting. Shingles that only one
of these texts holds can't be shared, which bounds the overlap of a text with any
other; and of two similar texts, the rarest shingles (as many as may be lacking, and
one) have one in common. Only pairs that both rules allow are compared; no link
between candidates is lost.

Banding misses a pair of similarity 0.8 with a chance of (1 - 0.8 ** ROWS) ** BANDS,
about 1e-7.

Edge cases: a text without words has an empty set and is linked with nothing; rows
that share an id are all linked to what any of them is linked to; null ids form a
component of null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.shingles import groups, hash_words, mix64, shingle_sets
from corrspark.session import materialise

WIDTH, PERCENT, BANDS, ROWS, PIVOTS = 4, 80, 40, 5, 2


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of 32-bit minima per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((coordinates, len(sets)), np.uint32)
    place = (mix64(np.concatenate(sets) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    a = 0
    while a < len(sets):  # pieces that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 32_768)))
        part, cuts = place[starts[a]:starts[b] if b < len(sets) else None], starts[a:b] - starts[a]
        rank, half = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint32(k), out=rank)  # the second permutation, shifted by k
            np.right_shift(rank, 16, out=half)
            np.bitwise_xor(rank, half, out=rank)
            np.multiply(rank, np.uint32(0x85EBCA6B), out=rank)
            np.right_shift(rank, 13, out=half)
            np.bitwise_xor(rank, half, out=rank)
            np.multiply(rank, np.uint32(0xC2B2AE35), out=rank)
            np.right_shift(rank, 16, out=half)
            np.bitwise_xor(rank, half, out=rank)
            out[k, a:b] = np.minimum.reduceat(rank, cuts)
        a = b
    return out.T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band; keys of different bands differ."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    for r in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return mix64(keys + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


_SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_of, data, offsets in groups(batch.column(1)):
                sets = shingle_sets(hash_words(data, offsets), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                band_lists: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, band_keys(circulant_signatures([sets[i] for i in full], bands * rows), bands, rows), strict=True):
                        band_lists[i] = k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows_of], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(band_lists, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in groups(batch.column(1)):
                sets = shingle_sets(hash_words(data, offsets), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node it reaches) from edges ``u, v``; both ends appear.

    Alternates stars around larger and smaller neighbours until nothing changes: a
    number of rounds that grows with the logarithm of the size.
    """
    def neighbours(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = neighbours(e) if larger else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        joined = both.join(low, "u")
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")) if larger else \
            joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        current = materialise(star(star(current, True), False), "edges")
        ends = current.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(current.select("v", F.lit(0), F.lit(1)))
        # done when all are stars: every node is either a root or has just one
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty():
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("u", "v")


def _pairs(asked: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different ``x, y``."""
    return asked.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _unsettled(labelled: DataFrame) -> DataFrame:
    """Rows of bands that hold members of several components."""
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least")).where("low <> high")
    return labelled.join(mixed.select("band", "least"), "band")


def _allowed(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components whose overlap may be large enough.

    An overlap is large enough if (100 + percent) * both >= percent * (n + m). A text
    shares at most the shingles that some other unsettled text holds too, so most
    texts can't reach any other in their bands, and leave. The others meet by the
    shingles that come first when all are ordered from rare to frequent.
    """
    rest = materialise(_unsettled(labelled), "rest")
    held = sets.join(rest.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    counts = materialise(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node")), "shingles")
    lone = counts.where("texts = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    bounded = rest.join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    able = bounded.where((100 + percent) * (F.col("n") - F.col("lone")) >= percent * (F.col("n") + F.col("least"))).drop("least")
    needed = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent))
    texts = materialise(
        _unsettled(able).groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("lone").alias("lone"), F.min("least").alias("least"))
        .select("node", "root", "n", (F.col("n") - needed + 1 - F.col("lone")).alias("first")), "able")
    rarity = Window.partitionBy("node").orderBy("texts", "shingle")
    leading = (
        held.join(texts, "node").join(counts.where("texts > 1").select("shingle", "texts"), "shingle")
        .withColumn("_at", F.row_number().over(rarity)).where("_at <= first").select("shingle", "node", "root", "n")
    )
    leading = materialise(leading, "leading")
    crossing = leading.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    left = leading.join(crossing, "shingle")
    right = left.select("shingle", *(F.col(c).alias(f"_{c}") for c in ("node", "root", "n")))
    alike = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    return _pairs(left.join(right, "shingle").where((F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & alike).select(F.col("node").alias("x"), F.col("_node").alias("y")))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = materialise(texts.mapInArrow(_sketch(width, bands, rows), _SKETCH), "sketches")
    filled = sketches.where(F.col("set_key").isNotNull())
    # a class of equal sets is named by its smallest id; rows without an id take no part
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.where(F.col("node").isNotNull()).select("node", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = materialise(members.join(shared, "band"), "crowd")
    popular = crowd.groupBy("node").agg(F.sum("size").alias("popular"))
    buckets = materialise(crowd.join(popular, "node").select("band", "node", "n", "popular"), "buckets")
    sets = materialise(
        texts.join(popular.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_full_sets(width), "node long, shingles array<long>"), "sets")

    # orders that hold everywhere, so that bands with common members ask for the same pairs
    orders = [F.struct("popular", "node"), *(F.struct(F.xxhash64(F.lit(k), F.col("node")).alias("h"), "node") for k in range(1, pivots))]
    chosen = buckets.groupBy("band").agg(F.array(*(F.max_by(F.struct("node", "n"), o) for o in orders)).alias("pivots"))
    to_pivots = buckets.join(chosen, "band").select("node", "n", F.explode("pivots").alias("pivot"))
    alike = 100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")  # sets too unlike in size can't be similar
    asked = materialise(_pairs(to_pivots.where(alike).select(F.col("node").alias("x"), F.col("pivot.node").alias("y"))), "asked")
    links = materialise(_links(asked, sets, percent), "links")
    roots = None if links.isEmpty() else components(links)
    labelled = buckets.select("band", "node", "n")
    if roots is None:
        labelled = labelled.withColumn("root", F.col("node"))
    else:
        labelled = labelled.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    further = _allowed(labelled, sets, percent).join(asked, ["u", "v"], "left_anti")
    found = materialise(_links(further, sets, percent), "links")
    if not found.isEmpty():
        roots = components(links.union(found))
    named = classes.select("set_key", F.col("node").alias("component_id"))
    if roots is not None:
        linked = roots.select(F.col("node").alias("component_id"), "root")
        named = named.join(linked, "component_id", "left").select("set_key", F.coalesce("root", "component_id").alias("component_id"))
    return sketches.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
