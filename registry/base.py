"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrspark.session import ship_package, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @functools.wraps(run)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(page: DataFrame) -> DataFrame:
    """The rows of a page with their place in its order (for the comparison with SQL)."""
    kept = page.withColumn("_m", F.monotonically_increasing_id())
    return kept.withColumn("place", F.row_number().over(Window.orderBy("_m"))).drop("_m")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, on all cores: cleaning and matching them is the work."""
    return spread(table(spark, folder, "documents"), "doc_id")


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "lineitem"), "l_orderkey")
