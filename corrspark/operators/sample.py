"""Samples: reproducible for a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _draw(key: Column, seed: int) -> Column:
    """A pseudo-random but fixed order of the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def per_year(df: DataFrame, key: str, time: str, n: int, start: int, end: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each year in [start, end]. Tasks keep n per year before the shuffle."""
    rows = df.withColumn("_year", F.year(time)).filter(F.col("_year").between(start, end))
    within = Window.partitionBy("_year").orderBy(_draw(F.col(key), seed), key)
    return rows.withColumn("_i", F.row_number().over(within)).filter(F.col("_i") <= n).drop("_i", "_year")


def uniform(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of the table; each task keeps its first n."""
    return df.orderBy(_draw(F.col(key), seed), key).limit(n)
