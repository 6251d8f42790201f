"""A training corpus from raw documents: language, copies, leaks, mixture, shards.

Counted as part of the package ``llm``; it goes where that package goes. Every stage
takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; between
stages rows are written to the shared folder and read again. All stages but the last
return the columns of ``documents``; the last returns the shard of every row.

Edge cases are those of the operators; rows are never lost for a null in any column
but the text's own verdict. Extra columns pass through the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrspark.llm import decontaminate, language_id, mixing, near_dedup, sharding
from corrspark.session import materialise, ship_package

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in none of the labelled languages, go."""
    ship_package(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group stays."""
    ship_package(spark)
    verdicts = near_dedup.near_duplicates(docs, width=SHINGLE_WORDS)
    gone = verdicts.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where(~F.col("_kept")).select("_gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.interleave(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Suffix automata and confirmed links of hashed shingles have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
