"""A dictionary of the words of a corpus: counts, lemma and stem, kept over batches.

The table is keyed by token in hash buckets (``sources.buckets``). A batch of texts
adds its counts, and only tokens that are new are lemmatised and stemmed; buckets
without a token of the batch keep their files. Counting is a partial aggregate, so
a frequent word is reduced where it lies.

Null and empty texts have no tokens. Batches are numbered upwards: a batch that was
merged already changes nothing when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrspark.functions import words as W
from corrspark.operators.clean import _rewrite
from corrspark.session import materialise
from corrspark.sources import buckets

#: Tokens as ``functions.words.TOKEN`` has them: words with inner dots and hyphens, or one sign.
TOKEN = r"(?U)[\p{L}\p{N}_]+(?:[.\-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"


def count_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` of all whole texts."""
    return texts.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def with_forms(counted: DataFrame, lemma=W.noun_lemma, stem=W.stem) -> DataFrame:
    """Lemma, and stem of the lemma, of every token."""
    return counted.withColumn("lemma", _rewrite(F.col("token"), lemma)).withColumn("stem", _rewrite(F.col("lemma"), stem))


def update(texts: DataFrame, root: str, batch: int, text: str = "text", lemma=W.noun_lemma, stem=W.stem) -> list[int]:
    """Add a batch of texts to the dictionary under ``root`` (or make it); the buckets that were rewritten."""
    fresh = materialise(count_tokens(texts, text), "tokens")
    known = buckets.read(texts.sparkSession, root)
    if known is None:
        rows = with_forms(fresh, lemma, stem)
    else:
        met = fresh.withColumnRenamed("n", "_more").join(known, "token", "left").filter(F.col("batch").isNull() | (F.col("batch") < batch))
        seen = met.filter(F.col("batch").isNotNull()).select("token", (F.col("n") + F.col("_more")).alias("n"), "lemma", "stem")
        new = with_forms(met.filter(F.col("batch").isNull()).select("token", F.col("_more").alias("n")), lemma, stem)
        rows = seen.unionByName(new)
    return buckets.merge(materialise(rows.withColumn("batch", F.lit(batch)), "words"), root, ["token"], ["batch"])
