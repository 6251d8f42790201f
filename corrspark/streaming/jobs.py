"""Incremental forms: feed refresh and queued correlation requests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from corrspark.operators.upsert import last_per_key
from corrspark.session import materialise, scratch_dir
from corrspark.sources import buckets

#: Buckets of the list of answered requests.
REQUEST_BUCKETS = 64


def upsert_stream(
    stream: DataFrame, root: str, keys: list[str], order: list[str], checkpoint: str | None = None
) -> StreamingQuery:
    """Add each micro-batch to the log of a table; see ``current`` for its rows.

    A batch costs what it holds, not what the table holds: it is reduced to one
    row per key and written to a folder named by the run and the batch, so a
    replayed batch overwrites itself. A row whose column ``deleted`` is true deletes
    its key.
    """
    mark = checkpoint or scratch_dir(stream.sparkSession, "upsert")
    run = hashlib.sha1(mark.encode()).hexdigest()[:12]

    def apply(batch: DataFrame, batch_id: int) -> None:
        path = f"{root.rstrip('/')}/log/run={run}/batch={batch_id}"
        tie = [buckets.DELETED] if buckets.DELETED in batch.columns else []
        last_per_key(batch, keys, [*order, *tie]).write.mode("overwrite").parquet(path)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .start()
    )


def _log(spark: SparkSession, root: str, known: buckets.Manifest | None) -> DataFrame | None:
    """Rows of the log that are not in the table yet, with their run and batch."""
    try:
        log = spark.read.option("mergeSchema", True).parquet(f"{root.rstrip('/')}/log").withColumn("run", F.col("run").cast("string"))
    except AnalysisException:
        return None
    for run, last in (known.folded if known else {}).items():
        log = log.filter((F.col("run") != run) | (F.col("batch") > last))
    return log if buckets.DELETED in log.columns else log.withColumn(buckets.DELETED, F.lit(False))


def current(spark: SparkSession, root: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The rows of a streamed table: the last of its buckets and its log per key, without deleted ones.

    The order columns decide, not arrival: a row that arrives late does not
    replace a later one, and a repeated row changes nothing.
    """
    known = buckets.manifest(spark, root)
    log = _log(spark, root, known)
    if log is None:
        return buckets.read(spark, root)
    log = log.drop("run", "batch")
    if known is not None:
        log = buckets.stored(spark, known).unionByName(log, allowMissingColumns=True)
    last = last_per_key(log.withColumn(buckets.DELETED, F.coalesce(buckets.DELETED, F.lit(False))), keys, [*order, buckets.DELETED])
    return last.filter(~F.col(buckets.DELETED)).drop(buckets.DELETED)


def compact(spark: SparkSession, root: str, keys: list[str], order: list[str], n_buckets: int = buckets.BUCKETS) -> list[int]:
    """Fold the log into the table, in place and while the stream runs; the buckets that were rewritten.

    The batches that are there now are folded and named in the manifest with the new
    rows, so a reader sees each of them in one place. The stream only adds batches.
    """
    known = buckets.manifest(spark, root)
    log = _log(spark, root, known)
    if log is None:
        return []
    done = {r["run"]: r["batch"] for r in log.groupBy("run").agg(F.max("batch").alias("batch")).collect()}  # one row per run
    if not done:
        return []
    taken = F.lit(False)
    for run, last in done.items():
        taken = taken | ((F.col("run") == run) & (F.col("batch") <= last))
    return buckets.merge(log.filter(taken).drop("run", "batch"), root, keys, order, n_buckets, done)


def compact_into(spark: SparkSession, root: str, new_root: str, keys: list[str], order: list[str]) -> list[int]:
    """Write the current rows as a table of their own; a stream may go on there with its old checkpoint."""
    return buckets.merge(current(spark, root, keys, order), new_root, keys, order)


def feed_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Feed files as they land, each picked up once."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("multiLine", True) if fmt == "json" else reader).load(path)


def request_stream(
    requests: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Queued requests to results, one result set per (task, id), see ``answers``.

    What is asked again is found in the list of answered requests, not in state
    that grows or forgets: late requests are answered, repeats are not, however
    far apart. The list lies in buckets of the keys' hash, and a batch reads those
    of its own keys only. Answers and list are written to folders named by the run and the
    batch, so another run on the same path adds to them and a replayed batch
    overwrites itself.
    """
    keys = ["task_id", "cve_id"]
    mark = checkpoint or scratch_dir(requests.sparkSession, "requests")
    name = hashlib.sha1(mark.encode()).hexdigest()[:12]
    root = path.rstrip("/")

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = f"run={name}/batch={batch_id}"
        asked = batch.select(*keys).distinct().withColumn("bucket", buckets.bucket_of(keys, REQUEST_BUCKETS))
        asked = materialise(asked, "asked")
        answered = answered_requests(batch.sparkSession, root, asked)
        if answered is not None:
            earlier = answered.filter((F.col("run") != name) | (F.col("batch") != batch_id))
            asked = materialise(asked.join(earlier.select(*keys), keys, "left_anti"), "asked")
        first = batch.dropDuplicates(keys).join(asked, keys, "left_semi")
        run(first).write.mode("overwrite").parquet(f"{root}/answers/{own}")
        asked.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/asked/{own}")

    return (
        requests.writeStream.foreachBatch(apply)
        .option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .start()
    )


def answered_requests(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame | None:
    """The list of answered requests in the buckets of some requests; the other buckets are not read."""
    touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most one per bucket
    try:
        answered = spark.read.option("basePath", f"{path}/asked").parquet(f"{path}/asked")
    except AnalysisException:  # the first batch: no list yet
        return None
    return answered.filter(F.col("bucket").isin(touched)).withColumn("run", F.col("run").cast("string"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All answers of a request stream."""
    return spark.read.option("basePath", f"{path.rstrip('/')}/answers").parquet(f"{path.rstrip('/')}/answers").drop("run", "batch")
