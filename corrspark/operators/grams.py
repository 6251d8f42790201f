"""Substring search by a posting index of three-letter pieces.

``build`` writes, for every piece of the lower-cased texts, lists of the keys of the
rows that hold it, one list per run of texts, in buckets of the piece's hash and in
order of the pieces, and a table of how many rows hold each. A search reads the few
rarest pieces of its query, from their buckets only, intersects their keys, and looks
the query up in the rows that are left. So it reads what the rarest pieces hold instead
of all texts, and its result is that of a scan. A query of fewer than three letters has
no piece and is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrspark.functions.pieces import pieces as runs
from corrspark.session import scratch_dir

SIZE, BUCKETS = 3, 16
#: Pieces of a query that are intersected: its rarest ones.
ASKED = 4


def pieces(text: Column) -> Column:
    """Distinct pieces of a lower-cased text, in time linear in it."""
    letters = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")

    def of(own: Column) -> Column:
        starts = F.when(F.size(own) >= SIZE, F.sequence(F.lit(0), F.size(own) - SIZE)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*(F.get(own, i + k) for k in range(SIZE)))))

    return F.transform(F.array(letters), of)[0]


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the row of each."""
    joined = "".join(texts.to_pylist())
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(texts)), sizes)


def _holders(columns: list[pa.Array]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(pieces, ends of their lists, rows of the lists) of a run of texts in some columns.

    A piece and its row are one number, so one sort brings them together; texts with
    too many different letters for that are taken in halves.
    """
    both = [_letters(c) for c in columns]
    alphabet = np.flatnonzero(np.bincount(np.concatenate([letters for letters, _ in both])))
    width, rows = len(alphabet), len(columns[0])
    place = np.zeros(alphabet[-1] + 1 if width else 0, np.int64)
    place[alphabet] = np.arange(width)
    if rows > 1 and width**SIZE * rows >= 1 << 63:
        at = 0
        for size in (rows // 2, rows - rows // 2):
            for names, ends, held in _holders([c.slice(at, size) for c in columns]):
                yield names, ends, held + at
            at += size
        return
    found = []
    for letters, row in both:
        code, n = place[letters], max(len(letters) - SIZE + 1, 0)
        piece = sum(code[k : k + n] * width ** (SIZE - 1 - k) for k in range(SIZE))
        whole = row[:n] == row[len(row) - n :]  # within one text
        found.append((piece * rows + row[:n])[whole])
    both = np.sort(np.concatenate(found))
    piece, held = np.divmod(both[np.flatnonzero(np.diff(both, prepend=-1))], max(rows, 1))
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    own = piece[first]
    spelled = alphabet[np.stack([own // width ** (SIZE - 1 - k) % max(width, 1) for k in range(SIZE)], 1)] if len(own) else own
    joined = spelled.astype("<u4").tobytes().decode("utf-32-le")
    yield [joined[i : i + SIZE] for i in range(0, len(joined), SIZE)], np.append(first, len(piece)), held


def build(table: DataFrame, key: str, columns: tuple[str, ...], path: str | None = None) -> str:
    """Write the index of some text columns; the folder it is in."""
    path = path or scratch_dir(table.sparkSession, "grams")
    texts = table.select(F.col(key).alias("key"), *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *own = batch.columns
            longest = max(own, key=lambda c: c.nbytes)
            for start, size in runs(longest):
                for names, ends, rows in _holders([c.slice(start, size) for c in own]):
                    held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(start + rows)))
                    n = pa.array(np.diff(ends), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), n, held], names=["piece", "n", "keys"])

    key_type = table.schema[key].dataType.simpleString()
    placed = texts.mapInArrow(lists, f"piece string, n long, keys array<{key_type}>").withColumn("bucket", _bucket(F.col("piece")))
    # a piece that very many rows hold is spread over files by its lists
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64("keys"), F.lit(16))).sortWithinPartitions("bucket", "piece")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = table.sparkSession.read.schema(placed.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "piece").agg(F.sum("n").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("piece").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    return path


def postings(spark: SparkSession, path: str, query: str, asked: int = ASKED) -> DataFrame | None:
    """Keys of the rows that hold the rarest pieces of a query; None if it has no piece."""
    wanted = spark.range(1).select(pieces(F.lit(query)).alias("p")).first()["p"]
    if not wanted:
        return None
    buckets = lambda names: spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, names)), _bucket)).alias("b")).first()["b"]
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("bucket").isin(buckets(wanted)) & F.col("piece").isin(wanted))
    known = {r["piece"]: r["n"] for r in counts.collect()}  # at most the query's pieces
    rare = sorted(wanted, key=lambda p: (known.get(p, 0), p))[:asked]
    stored = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets(rare)) & F.col("piece").isin(rare))
    # rows of one key may stand in several lists of a piece
    held = stored.select("piece", F.explode("keys").alias("key")).distinct()
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare)).select("key")


def contains(columns: tuple[str, ...], query: str) -> Column:
    """Whether any of the columns holds the query, whatever its case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(query))) for c in columns])


def search(table: DataFrame, key: str, columns: tuple[str, ...], query: str, path: str) -> DataFrame:
    """The rows of the indexed table that hold a query in one of its columns."""
    keys = postings(table.sparkSession, path, query)
    rows = table if keys is None else table.join(keys.withColumnRenamed("key", key), key, "left_semi")
    return rows.filter(contains(columns, query))


def suggestions(table: DataFrame, key: str, query: str, path: str, detail: Column, limit: int = 10) -> DataFrame:
    """First ids that contain the query, whatever its case, by the index."""
    return search(table, key, (key,), query, path).select(F.col(key).alias("id"), detail.alias("detail")).orderBy("id").limit(limit)
