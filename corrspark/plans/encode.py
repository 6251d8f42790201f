"""Texts to vectors.

An encoder is a function from rows with a ``text`` column to the same rows with a
``vector`` column: stored vectors, a model loaded once per task, or the built-in
hashed TF-IDF. All but the first are maps without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from corrspark.functions.pieces import pieces
from corrspark.session import materialise
from corrspark.sources import buckets

Encode = Callable[[DataFrame], DataFrame]
Model = Callable[[list[str]], np.ndarray]


def stored(vectors: DataFrame) -> Encode:
    """Vectors from a table of (text, vector)."""
    return lambda rows: rows.join(vectors.select("text", "vector"), "text", "left")


def encode_with(load: Callable[[], Model], batch_size: int = 64) -> Encode:
    """``load`` builds the model once per task; equal texts of a piece of a batch are encoded once; other
    columns pass by as they are.

    If the model fails on a group of texts, they are given to it one by one; a text
    that it can't encode has no vector, which ``correlate`` reports. A model that
    can't be loaded fails the job.
    """

    def encoded(model: Model, texts: list[str]) -> dict[str, np.ndarray]:
        try:
            return dict(zip(texts, np.asarray(model(texts), dtype=np.float32)))
        except Exception:  # whatever the model raises: find out which text it can't take
            if len(texts) == 1:
                return {}
            return {t: v for text in texts for t, v in encoded(model, [text]).items()}

    def vectors_of(model: Model, column: pa.Array) -> pa.Array:
        known = pc.drop_null(column.unique()).to_pylist()
        vectors: dict[str, np.ndarray] = {}
        for start in range(0, len(known), batch_size):
            vectors.update(encoded(model, known[start : start + batch_size]))
        return pa.array([vectors.get(t) for t in column.to_pylist()], pa.list_(pa.float32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            texts = batch.column("text")
            for start, size in pieces(texts):
                piece = batch.slice(start, size)
                yield pa.RecordBatch.from_arrays([*piece.columns, vectors_of(model, piece.column("text"))], names=[*batch.schema.names, "vector"])

    def apply(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType()))]))

    return apply


def encode_once(encode: Encode) -> Encode:
    """Encode each distinct text once and join the vectors back.

    Worth its shuffle when the model is slow and texts repeat across the table.
    """

    def apply(rows: DataFrame) -> DataFrame:
        distinct = rows.select("text").filter(F.col("text").isNotNull()).distinct()
        return stored(encode(distinct))(rows)

    return apply


def digest_of(model: str, text: Column) -> Column:
    """The 128-bit key of a text's vector under a model."""
    return F.md5(F.concat(F.lit(model + "\n"), text).cast("binary"))


def encode_incremental(encode: Encode, root: str, model: str) -> Encode:
    """Encode only texts whose vectors are not in a store, and add these to it.

    The store is a table in buckets keyed by a digest of model and text, so a run
    joins on 16 bytes, reads and rewrites only what it touches, and encodes each
    distinct text once, whichever run or table it came with. A text that the model
    can't take has no vector and is tried again by the next run.
    """

    def apply(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        keyed = rows.withColumn("_digest", digest_of(model, F.col("text")))
        asked = keyed.filter(F.col("text").isNotNull()).groupBy("_digest").agg(F.first("text").alias("text"))
        known = buckets.read(spark, root)
        fresh = asked if known is None else asked.join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
        encoded = materialise(encode(fresh).filter(F.col("vector").isNotNull()).select(F.col("_digest").alias("digest"), "vector", F.lit(0).alias("at")), "vectors")
        buckets.merge(encoded, root, ["digest"], ["at"])
        vectors = buckets.read(spark, root).select(F.col("digest").alias("_digest"), "vector")
        return keyed.join(vectors, "_digest", "left").drop("_digest")

    return apply


def fit_hashed(texts: DataFrame, dim: int = 256) -> Encode:
    """A hashed TF-IDF encoder whose document frequencies are those of ``texts``."""
    encode = encode_hashed(dim)
    encode(texts)
    return encode


def encode_hashed(dim: int = 256) -> Encode:
    """Hashed TF-IDF over the words of the rows, the same on every run.

    A word's slot is the first 32 bits of its md5 digest modulo ``dim``.
    Document frequencies are those of the first rows encoded (``correlate`` encodes
    the patterns first), so that queries and patterns share one weighting; fitting
    them is one aggregate of ``dim`` counts. ``fit_hashed`` names the rows instead.
    """
    fitted: list = []

    def apply(rows: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
        slots = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("string"))
        counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_words", outputCol="_tf")
        counts = counter.transform(rows.withColumn("_words", slots))
        if not fitted:
            fitted.append(IDF(inputCol="_tf", outputCol="_tfidf").fit(counts))
        weighted = fitted[0].transform(counts)
        vector = F.when(F.col("text").isNotNull(), vector_to_array("_tfidf", "float32"))
        return weighted.withColumn("vector", vector).drop("_words", "_tf", "_tfidf")

    return apply
