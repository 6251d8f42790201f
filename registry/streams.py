"""Streaming forms, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrspark.session import scratch_dir
from corrspark.sources import buckets
from corrspark.streaming import jobs
from registry.base import query, table


def stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("stream_upsert", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id
""")
def stream_upsert(spark, folder):
    rows = stream(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    root = scratch_dir(spark, "snapshot")
    jobs.upsert_stream(rows, root, ["user_id"], ["event_id"]).awaitTermination()
    return jobs.current(spark, root, ["user_id"], ["event_id"])


@query("stream_requests", "SELECT DISTINCT event_type AS task_id, user_id AS cve_id, c_name FROM events JOIN customer ON c_custkey = user_id")
def stream_requests(spark, folder):
    """Each (task, id) is answered once, from a static table, also over two runs on one path."""
    rows = stream(spark, folder, "events").select(F.col("event_type").alias("task_id"), F.col("user_id").alias("cve_id"))
    answers = table(spark, folder, "customer").select(F.col("c_custkey").alias("cve_id"), "c_name")
    path = scratch_dir(spark, "answers")
    run = lambda batch: batch.join(answers, "cve_id").select("task_id", "cve_id", "c_name")
    jobs.request_stream(rows.filter("cve_id % 3 > 0"), run, path).awaitTermination()
    jobs.request_stream(rows, run, path).awaitTermination()
    return jobs.answers(spark, path).select("task_id", "cve_id", "c_name")


@query("stream_delete", """
SELECT user_id, event_id, value FROM (
  SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS last, arg_max(value, event_id) AS value FROM events GROUP BY user_id) WHERE last <> 'purchase'
""")
def stream_delete(spark, folder):
    """A stream of rows and deletes over two runs; its log is folded in place between and after them."""
    rows = stream(spark, folder, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").alias("deleted"))
    root, mark = scratch_dir(spark, "table"), scratch_dir(spark, "mark")
    keys, order = ["user_id"], ["event_id"]
    jobs.upsert_stream(rows.filter("user_id % 2 = 0 OR event_id % 3 > 0"), root, keys, order, mark).awaitTermination()
    jobs.compact(spark, root, keys, order)
    jobs.upsert_stream(rows, root, keys, order).awaitTermination()
    jobs.compact(spark, root, keys, order)
    return jobs.current(spark, root, keys, order).select("user_id", "event_id", "value")


@query("bucket_merge", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id) WHERE event_id % 7 <> 0
""")
def bucket_merge(spark, folder):
    """A keyed table in buckets, made of three merges that arrive out of order, and a delete as of each key's last row."""
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    root, keys, order = scratch_dir(spark, "buckets"), ["user_id"], ["event_id"]
    for part in (2, 0, 1):
        buckets.merge(rows.filter(F.col("event_id") % 3 == part), root, keys, order)
    last = buckets.read(spark, root)
    buckets.delete(last.filter("event_id % 7 = 0"), root, keys, order)
    buckets.merge(rows.filter("event_id % 5 = 0"), root, keys, order)  # repeated rows change nothing
    return buckets.read(spark, root).select("user_id", "event_id", "event_type", "value")
