"""Keyed tables in hash buckets: a merge or a delete rewrites only the buckets it touches.

A table is a folder of versions and a list of manifests. A row lies in the bucket of
its key's hash; the newest manifest names, per bucket, the folder of its rows. A merge
reads the buckets of its own keys, keeps the last row per key by the order columns,
writes these buckets to a new folder and adds a manifest that names it; all other
buckets keep their files. Nothing is ever overwritten, so a job that dies leaves the
table as it was, and readers keep what they opened.

A row whose column ``deleted`` is true is a tombstone: it hides its key from readers
and loses only to a later row (not to one of its own time), so it stays until :func:`merge` is asked to ``drop``
tombstones, which may be done when no earlier row can arrive any more.

One writer at a time merges into a table; streams write to their own log (see
``streaming.jobs``), which a merge folds in.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from corrspark.operators.upsert import last_per_key

BUCKET, DELETED = "_bucket", "deleted"
#: Buckets of a new table; the manifest names each of them.
BUCKETS = 64


@dataclass
class Manifest:
    """What a version of a table is made of."""

    number: int
    keys: list[str]
    order: list[str]
    buckets: int
    schema: dict
    parts: dict[str, str] = field(default_factory=dict)  # bucket to folder
    folded: dict[str, int] = field(default_factory=dict)  # run of a stream to its last batch that is in


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest manifest of a table."""
    try:
        rows = spark.read.schema("value string, number int").text(f"{root.rstrip('/')}/_manifests")
    except AnalysisException:
        return None
    newest = rows.agg(F.max_by("value", "number").alias("value")).first()
    return Manifest(**json.loads(newest["value"])) if newest["value"] else None


def _publish(spark: SparkSession, root: str, made: Manifest) -> None:
    text = spark.createDataFrame([(json.dumps(asdict(made)),)], "value string").coalesce(1)
    text.write.mode("overwrite").text(f"{root.rstrip('/')}/_manifests/number={made.number}")


def stored(spark: SparkSession, known: Manifest, buckets: list[int] | None = None) -> DataFrame:
    """All rows of some buckets, tombstones among them."""
    schema = StructType.fromJson(known.schema)
    paths = [f"{folder}/{BUCKET}={b}" for b, folder in known.parts.items() if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def merge(
    rows: DataFrame, root: str, keys: list[str], order: list[str], buckets: int = BUCKETS, folded: dict[str, int] | None = None, drop: bool = False
) -> list[int]:
    """Merge rows into a table (or make it); the buckets that were rewritten.

    The order columns decide, not arrival, so a repeated merge changes nothing. New
    columns are added to the table. ``drop`` removes the tombstones of the touched
    buckets, ``folded`` is noted in the manifest.
    """
    spark = rows.sparkSession
    known = manifest(spark, root)
    if known is not None and (known.keys != keys or known.order != order):
        raise ValueError(f"the table is keyed by {known.keys} and ordered by {known.order}")
    count = known.buckets if known else buckets
    rows = rows if DELETED in rows.columns else rows.withColumn(DELETED, F.lit(False))
    placed = rows.withColumn(DELETED, F.coalesce(DELETED, F.lit(False))).withColumn(BUCKET, bucket_of(keys, count))
    touched = sorted(r[BUCKET] for r in placed.select(BUCKET).distinct().collect())  # at most one per bucket
    if touched:
        whole = placed
        if known:
            old = stored(spark, known, touched).withColumn(BUCKET, bucket_of(keys, count))
            whole = old.unionByName(placed, allowMissingColumns=True)
        last = last_per_key(whole, [*keys, BUCKET], [*order, DELETED])  # as of one time a delete wins
        last = last.filter(~F.col(DELETED)) if drop else last
        folder = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
        last.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        schema = last.drop(BUCKET).schema.jsonValue()
        filled = {r[BUCKET] for r in spark.read.schema(last.schema).parquet(folder).select(BUCKET).distinct().collect()}
    else:
        schema, filled, folder = (known.schema if known else rows.schema.jsonValue()), set(), ""
    parts = {b: p for b, p in (known.parts if known else {}).items() if int(b) not in touched}
    parts |= {str(b): folder for b in touched if b in filled}
    _publish(spark, root, Manifest(known.number + 1 if known else 0, keys, order, count, schema, parts, (known.folded if known else {}) | (folded or {})))
    return touched


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The current rows of a table, without deleted ones; None if there is no table."""
    known = manifest(spark, root)
    return None if known is None else stored(spark, known).filter(~F.col(DELETED)).drop(DELETED)


def delete(doomed: DataFrame, root: str, keys: list[str], order: list[str]) -> list[int]:
    """Delete keys as of the order columns that come with them."""
    return merge(doomed.select(*keys, *order).withColumn(DELETED, F.lit(True)), root, keys, order)
