"""Awkward tables that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHES = ("size", "shard", "target", "failed", "words", "_text", "_source", "_draw", "_slice", "_gone", "kept", "band", "h", "f", "copy")
SYLLABLES = "the ing and tion er ou re th a on".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    long = prose(1, 20_000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "s1", 7),
        (4, "one", "en", None, 3),
        (5, "###!! 12 34 $$", None, "s2", 5),
        (6, long, "en", "s1", len(long)),
        (7, long, "en", "s1", len(long)),
        (8, long + " tail words here", "en", "s2", None),
        (9, prose(2, 300), "fr", "", 1),
        (10, prose(2, 299), "fr", "s2", 1),
        (11, "x" * 5_000, None, "s1", 1),
        (12, "née Élan voilà 你好 \U0001f600", "fr", "s1", 1),
        (13, "zero\x00byte " * 30, "en", "s1", 1),
        (14, prose(3, 60), "en", "s1", 1),
        (14, prose(3, 60), "en", "s1", 1),  # a repeated row
        (None, prose(4, 60), "en", "s1", 1),
    ]
    return rows + [(100 + i, prose(50 + i % 3, 80), "en", "hot", 1) for i in range(40)]  # ties and a hot source


def frame(spark, rows, partitions: int = 3, clashes: bool = False):
    df = spark.createDataFrame(rows, DOCS).repartition(partitions)
    if clashes:
        from pyspark.sql import functions as F

        for i, name in enumerate(CLASHES):
            df = df.withColumn(name, F.lit(f"other {i}"))
    return df
