"""Joining a large table with a catalogue inside Arrow batches.

A catalogue (patterns, keywords, product terms) is usually small. Its size is
measured first. Up to ``limit`` bytes it is broadcast and the large table is
mapped in place, without a shuffle. A larger catalogue never passes the driver: it
is cut into blocks of whole keys within the limit, which Spark writes to the shared
folder; every task reads them from there, one at a time, for each of its batches.
Blocks that have vectors are cut by nearness, so that a caller can skip those that
no row of a batch can use. Neither table is copied, the large one is not shuffled,
and equal or missing keys stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from corrspark.session import materialise, scratch_dir

BROADCAST_LIMIT = 128 << 20
# result cells worked out at a time: bounds the memory of a task, whatever the catalogue
CELLS = 1 << 22
# the same where a cell may be a hit of a text
ARROW_CELLS = 1 << 18


def measured_size(catalogue: DataFrame, row_bytes: Column) -> int:
    return int(catalogue.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).cast("long").alias("b")).first()["b"])


def vector_bytes(vector: Column) -> Column:
    return F.coalesce(F.size(vector) * 8, F.lit(0)) + 64


def text_bytes(*texts: Column) -> Column:
    total = F.lit(128)
    for text in texts:
        total = total + F.coalesce(F.octet_length(text), F.lit(0)) * 2
    return total


Batch = TypeVar("Batch", pd.DataFrame, pa.RecordBatch)
Apply = Callable[[Batch, object], Batch]


def _in_pieces(batch: Batch, prepared: object, apply: Apply, cells: int) -> Iterator[Batch]:
    """Results of a batch, taken in pieces whose rows times the catalogue's width fit."""
    width = prepared.width if hasattr(prepared, "width") else len(prepared)
    step = max(1, cells // max(1, width))
    rows = batch.num_rows if isinstance(batch, pa.RecordBatch) else len(batch)
    for start in range(0, rows, step):
        piece = batch.slice(start, step) if isinstance(batch, pa.RecordBatch) else batch.iloc[start : start + step]
        out = apply(piece, prepared)
        if out.num_rows if isinstance(out, pa.RecordBatch) else len(out):
            yield out


ROW = "_row"


@dataclass
class Blocks:
    """A catalogue for tasks: broadcast as a whole, or written block by block.

    ``centres`` and ``radii`` bound the unit vectors of each block, where it has any.
    """

    whole: Broadcast | None = None
    path: str = ""
    names: list[int] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None

    def __len__(self) -> int:
        return 1 if self.whole is not None else len(self.names)

    def load(self, i: int) -> pd.DataFrame:
        """A block's rows, read by the task."""
        if self.whole is not None:
            return self.whole.value
        store, root = pyarrow.fs.FileSystem.from_uri(f"{self.path}/_block={self.names[i]}")
        return pyarrow.dataset.dataset(root, filesystem=store, format="parquet").to_table().to_pandas()

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """Per row and block the largest product that a unit vector of the block can give."""
        if self.centres is None:
            return np.ones((len(units), len(self)))
        return np.minimum(units @ self.centres.T + self.radii + 1e-9, 1.0)


# vectors that blocks are gathered around, at most; they and the blocks' centres go to every task
PIVOTS = 1_024


def catalogue_blocks(catalogue: DataFrame, row_bytes: Column, key: str, limit: int = BROADCAST_LIMIT, vector: str | None = None) -> Blocks:
    """The catalogue as blocks of at most ``limit`` bytes; rows of a key stay together."""
    kept = catalogue.persist(StorageLevel.MEMORY_AND_DISK)  # measured and read: derive it once
    size = measured_size(kept, row_bytes)
    if size <= limit:
        whole = catalogue.sparkSession.sparkContext.broadcast(kept.toArrow().to_pandas())
        kept.unpersist()
        return Blocks(whole=whole)
    near = _near_pivots(kept, key, vector, math.ceil(2 * size / limit)) if vector else kept.select(key).distinct().withColumn("_near", F.lit(0))
    near = materialise(near, "near")
    sized = kept.groupBy(key).agg(F.sum(row_bytes).alias("_bytes")).join(near, key)
    groups = {r["_near"]: (r["b"], r["m"]) for r in sized.groupBy("_near").agg(F.sum("_bytes").alias("b"), F.max("_bytes").alias("m")).collect()}  # one row per pivot
    largest = max(m for _, m in groups.values())
    if largest > limit:
        raise ValueError(f"one key of the catalogue takes {largest} bytes; the limit is {limit}")
    parts = {g: max(1, math.ceil(2 * b / limit)) if b > limit else 1 for g, (b, _) in groups.items()}
    while True:
        count = F.coalesce(*(F.when(F.col("_near") == g, F.lit(n)) for g, n in parts.items() if n > 1), F.lit(1))
        cut = sized.withColumn("_part", F.pmod(F.xxhash64(key), count))
        over = [r for r in cut.groupBy("_near", "_part").agg(F.sum("_bytes").alias("b")).collect() if r["b"] > limit]
        if not over:
            break
        for g in {r["_near"] for r in over}:
            parts[g] *= 2
    first, base = {}, 0
    for g, n in sorted(parts.items()):
        first[g], base = base, base + n
    start = F.element_at(F.create_map(*[F.lit(x) for g, b in first.items() for x in (g, b)]), F.col("_near"))
    placed = kept.join(cut.select(key, (start + F.col("_part")).cast("int").alias("_block")), key)
    path = scratch_dir(catalogue.sparkSession, "blocks")
    placed.repartition("_block").write.partitionBy("_block").parquet(path)
    kept.unpersist()
    out = Blocks(path=path)
    stored = catalogue.sparkSession.read.schema(placed.schema).parquet(path)
    if vector is None:
        out.names = sorted(r["_block"] for r in stored.select("_block").distinct().collect())
        return out
    balls = sorted((r["block"], r["centre"], r["radius"]) for r in stored.groupBy("_block").applyInPandas(lambda rows: _ball(rows, vector), "block int, centre array<double>, radius double").collect())
    out.names = [b for b, _, _ in balls]
    wide = max((len(c) for _, c, _ in balls), default=0)
    if wide and all(len(c) in (0, wide) for _, c, _ in balls):
        out.centres = np.array([c or [0.0] * wide for _, c, _ in balls])
        out.radii = np.array([r for _, _, r in balls])
    return out


def units_of(vectors) -> np.ndarray:
    matrix = np.asarray(list(vectors), dtype=np.float64)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _ball(rows: pd.DataFrame, vector: str) -> pd.DataFrame:
    """Centre and radius of a block's unit vectors."""
    known = [v for v in rows[vector] if v is not None]
    units = units_of(known) if known else np.zeros((0, 0))
    centre = units.mean(axis=0) if len(units) else np.zeros(0)
    radius = float(np.sqrt(((units - centre) ** 2).sum(axis=1)).max()) if len(units) else 0.0
    return pd.DataFrame({"block": [int(rows["_block"].iloc[0])], "centre": [centre.tolist()], "radius": [radius]})


def _near_pivots(catalogue: DataFrame, key: str, vector: str, wanted: int) -> DataFrame:
    """(key, _near): the nearest of some of the keys' own vectors, which lie far apart in a seeded sample."""
    firsts = catalogue.groupBy(key).agg(F.min_by(vector, F.xxhash64(vector)).alias(vector))
    known = firsts.filter(F.col(vector).isNotNull())
    wanted = min(PIVOTS, max(2, wanted))
    pivots = _far_apart(units_of(r[vector] for r in known.orderBy(F.xxhash64(key)).limit(4 * wanted).collect()), wanted)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = units_of(np.zeros(pivots.shape[1]) if v is None else v for v in batch[vector])
            yield pd.DataFrame({key: batch[key], "_near": np.argmax(own @ pivots.T, axis=1).astype(np.int32)})

    if not len(pivots):
        return firsts.select(key, F.lit(0).alias("_near"))
    return firsts.mapInPandas(nearest, f"{key} {catalogue.schema[key].dataType.simpleString()}, _near int")


def _far_apart(units: np.ndarray, wanted: int) -> np.ndarray:
    """Some of the vectors: each one the farthest from those before it."""
    if len(units) <= wanted:
        return units
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < wanted:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def numbered(large: DataFrame) -> DataFrame:
    """The rows with a number each, written once: every block reads the same ones."""
    return materialise(large.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


class Loaded:
    """The prepared block a task holds: one at a time."""

    def __init__(self, blocks: Blocks, prepare: Callable[[pd.DataFrame], object]):
        self.blocks, self.prepare, self.at, self.prepared, self.reads = blocks, prepare, -1, None, 0

    def get(self, i: int):
        if i != self.at:
            self.prepared = None  # before the next one is read
            self.prepared, self.at = self.prepare(self.blocks.load(i)), i
            self.reads += 1
        return self.prepared


def map_blocks(large: DataFrame, blocks: Blocks, prepare: Callable[[pd.DataFrame], object], apply: Apply, schema: str, arrow: bool = False) -> DataFrame:
    """Rows of ``apply(batch, prepare(block))`` of every batch and block.

    What ``prepare`` gives has a ``width`` (or a length): the result cells per row
    of the large table. With ``arrow`` batches are Arrow's own, so that lists and
    texts become Python objects only where ``apply`` looks at them.
    """
    cells = min(CELLS, ARROW_CELLS) if arrow else CELLS

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        loaded = Loaded(blocks, prepare)
        order = list(range(len(blocks)))
        for batch in batches:
            for i in order:
                yield from _in_pieces(batch, loaded.get(i), apply, cells)
            order.reverse()  # the block that is held comes first

    return large.mapInArrow(run, schema) if arrow else large.mapInPandas(run, schema)
