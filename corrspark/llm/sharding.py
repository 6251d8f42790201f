"""Sharding by proportional stratified interleaving (operator 5).

Rows of every source are put in a seeded order; row k of n gets the fraction
(k - 1/2) / n. Sorting all rows by fraction interleaves the sources in proportion,
and cutting that order into equal pieces gives shards that all match the mixture.
Law: ``rows`` (counts of shards differ by one at most).

No source and no shard needs a task of its own: ranks are running counts over
slices of the order (``common.running``). Texts are not moved.

Edge cases: null ids, texts (no bytes) and sources (a source of its own) are kept;
repeated rows each get a slot; rows equal in all fields share places in any order;
fewer rows than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.llm.common import DRAWS, group_key, running, seeded

SHARDS, SEED = 24, "interleave-1"
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def sizes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    rows = docs.select(
        F.col("doc_id"), sizes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        group_key(F.col("source")).alias("_source"),
    ).withColumn("_draw", seeded(seed, F.col("doc_id")))
    ties = ("_draw", "doc_id", "text_crc32", "size")
    ranked = running(rows, "_source", F.col("_draw") / DRAWS, [F.col(c) for c in ties], F.lit(1), "_rank", "_in_source")
    placed = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_in_source"))).withColumn("_all", F.lit(0))
    order = [F.col(c) for c in ("_fraction", "_source", *ties)]
    cut = running(placed, "_all", F.col("_fraction"), order, F.lit(1), "_place", "_n", slices=4096)
    return cut.withColumn("shard", F.expr(f"cast(_place * {shards} div _n as int)")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_place") - F.expr(f"(shard * _n + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
