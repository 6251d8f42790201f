"""Helpers of the operators: word classes, seeded order, distributed running sums, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, and a word (Java and RE2 syntax).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Running sums are cut into so many slices of the seeded order, so that no key needs one task.
SLICES = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text in order; no text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def seeded(seed: str, key: Column) -> Column:
    """A 60-bit number drawn from the seed and the key; the same on every run and machine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("-")))), 1, 15), 16, 10).cast("long")


def group_key(value: Column) -> Column:
    """A non-null join key of a nullable string; null is a group of its own."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), value))


def running(
    df: DataFrame, group: str, fraction: Column, order: Sequence[Column], weight: Column, before: str, total: str,
    slices: int = SLICES, facts: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over earlier rows of the group, and over all its rows.

    ``fraction`` (0 to 1, below 1) must follow ``order``; it cuts the order of a
    group into slices. Sums of slices are small and give the offsets, so that a
    group with any share of the rows is spread over ``slices`` windows. ``facts``
    has one row per group; its columns come along with the offsets, so that no
    join of the rows has the bare group as its key.
    """
    cut, own, lead = fresh(df, "_slice"), fresh(df, "_weight"), fresh(df, "_lead")
    cut_df = df.withColumn(cut, F.floor(fraction * slices).cast("int")).withColumn(own, weight.cast("long"))
    sums = cut_df.groupBy(group, cut).agg(F.sum(own).alias(own))
    along = Window.partitionBy(group).orderBy(cut)
    offsets = sums.select(
        group, cut,
        F.coalesce(F.sum(own).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(lead),
        F.sum(own).over(Window.partitionBy(group)).alias(total),
    )
    if facts is not None:
        offsets = offsets.join(facts, group)
    inside = Window.partitionBy(group, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut_df.withColumn(before, F.coalesce(F.sum(own).over(inside), F.lit(0)))
        .join(offsets, [group, cut])
        .withColumn(before, F.col(before) + F.col(lead))
        .drop(cut, own, lead)
    )


#: 2 ** 60, the range of :func:`seeded`.
DRAWS = float(1 << 60)
