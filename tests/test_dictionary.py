import collections
import itertools
import random

import duckdb

from corrspark.functions import words as W
from corrspark.operators import dictionary
from corrspark.sources import buckets
from registry import stem_sql


def sql_stems(words):
    db = duckdb.connect()
    db.execute("CREATE TABLE given (t VARCHAR)")
    db.executemany("INSERT INTO given VALUES (?)", [[w] for w in words])
    return dict(db.execute(f"WITH {stem_sql.stems('given')} SELECT t, stem FROM stems").fetchall())


def test_stems_by_rule_chain_equal_the_function():
    draw = random.Random(7)
    ends = ["", "s", "sses", "ies", "ied", "eed", "ed", "ing", "y", "logi", "ement", "ment", "ent", "ion", "e", "ll", "al", "alli"]
    ends += [r[0] for rules in (*W.STEP2.values(), *W.STEP3.values()) for r in rules] + [s for rules in W.STEP4.values() for s in rules]
    roots = ["".join(draw.choices("abdeilosty", k=draw.randint(0, 5))) for _ in range(40)]
    words = {a + b for a, b in itertools.product(roots, ends)} | set(W.IRREGULAR_STEMS) | {"Yyy", "SKIES", "é", "x1", "."}
    words.discard("")
    assert sql_stems(sorted(words)) == {w: W.stem(w) for w in words}


def counted(texts):
    return collections.Counter(t for text in texts for t in W.tokens(text or ""))


def test_batches_add_up_and_repeats_change_nothing(spark, tmp_path):
    root = str(tmp_path / "words")
    first = ["the servers, the server", None, "", "v1.2 a-b é"]
    second = ["the Servers run", "running skies"]
    frame = lambda texts: spark.createDataFrame([(t, "x") for t in texts], "text string, token string")

    dictionary.update(frame(first), root, 0)
    before = buckets.manifest(spark, root).parts
    touched = dictionary.update(frame(second), root, 1)
    after = buckets.manifest(spark, root).parts
    assert all(after[b] == before[b] for b in before if int(b) not in touched) and len(touched) <= 5
    assert dictionary.update(frame(second), root, 1) == []
    got = {r["token"]: (r["n"], r["lemma"], r["stem"]) for r in buckets.read(spark, root).collect()}
    assert got == {t: (n, W.noun_lemma(t), W.stem(W.noun_lemma(t))) for t, n in counted(first + second).items()}


def test_no_texts(spark, tmp_path):
    root = str(tmp_path / "none")
    empty = spark.createDataFrame([], "text string")
    dictionary.update(empty, root, 0)
    dictionary.update(empty, root, 1)
    assert buckets.read(spark, root).count() == 0
