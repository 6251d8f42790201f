"""Golden rows of the cleaning steps."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corrspark.functions import text as T
from corrspark.operators import clean

CASES = [
    (T.lowercase, "ABC Éa", "abc éa"),
    (T.remove_puncts, "One, two; three. Four v1.2 file.exe.  End.", "One two three Four v1.2 file.exe End."),
    (T.remove_space_newline, " a\n\tb \r c  d ", "a b c d"),
    (T.remove_links, "see https://a.b/c?d and www.x.org xhttp://no end", "see and xhttp://no end"),
    (T.remove_digits, "a1 22 b", "a b"),
    (T.remove_punctuation, "a-b/c . file.exe (x)! end.", "a b c  file.exe x end."),
    (lambda c: T.remove_punctuation(c, False), "a-b file.exe!", "a b fileexe"),
    (T.remove_parentheses_content, "a (b) c (d (e) f)", "a c f)"),
    (T.remove_special_characters, "a-b é_c! d", "ab é_c d"),
    (T.remove_dates, "on 1/2/2020 or 2020-01-02 in March, MAY", "on or in ,"),
    (T.expand_contractions, "I can't and won't; don't, it's John's, we're", "I cannot and will not; do not, it is John's, we are"),
    (T.genitive, "the user's name and users' data", "the name of user and data of users"),
    (T.remove_versions, "apache 1.3.11 through 1.3.20 before 2.0, and version 5 sp2 v1.2 9.x", "apache, and"),
    (T.remove_entities, "CVE-2021-34527 see cwe-79, capec-66.", "see , ."),
    (T.remove_file_paths, "open /etc/passwd or C:/a/b.txt now", "open or now"),
    (T.remove_file_names, "run a.exe and b.md and notes.txt", "run and b.md and"),
    (T.remove_stop_words, "The cat is on the Mat", "cat Mat"),
    (T.sentence_tokenization, "One.  Two!\nThree", "One. Two! Three"),
    (T.advanced_tokenization, "Hello, world! don't x-y 1.2", "Hello world don't x-y 1.2"),
    (T.clean_for_aggregation, "A/B-c, (d)!\n e", "a b c d e"),
    (T.clean_for_aggregation, None, ""),
    (T.inner_text, "An <xhtml:b>x</xhtml:b>\n uses <script>", "An x uses <script>"),
    (T.inner_text, None, None),
    (T.uniform_string, "SQL_Injection (a/b), v1.2 .php end. Go", "sql injection a b v1.2 php end go"),
    (T.strip_parentheses, "a (b)  c", "a c"),
    (T.first_parentheses, "a (b) (c)", "b"),
    (T.first_parentheses, "none", "none"),
    (clean.replace_file_paths, r"see /etc/passwd and C:\x\y.dll ok", "see file and dll file ok"),
    (clean.remove_consecutive_repeats, "a aardvark the the the end. END", "ardvark the end"),
]


@pytest.mark.parametrize("step,given_,want", CASES, ids=range(len(CASES)))
def test_step(spark, step, given_, want):
    df = spark.createDataFrame([(given_,)], "t string")
    assert df.select(step(F.col("t")).alias("x")).first()["x"] == want


def test_lists(spark):
    df = spark.sql("""select array('A-b', '', null, 'C!') as l,
        array(named_struct('Scope', array('Conf'), 'Impact', array('Read', 'Write'), 'Note', cast(null as string))) as c,
        array(named_struct('Level', 'Low', 'Description', 'Know-how'), named_struct('Level', 'High', 'Description', '')) as s""")
    row = df.select(T.clean_list(F.col("l")).alias("l"), T.clean_consequences(F.col("c")).alias("c"), T.clean_skills(F.col("s")).alias("s"),
                    T.join_fields(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("j")).first()
    assert row["l"] == ["a b", "c"]
    assert row["c"] == ["scope conf impact read write note none"]
    assert row["s"] == ["know how"]
    assert row["j"] == "a  b"


def test_options():
    o = clean.service_options({"remove_stopwords": True, "lemmatization": True, "remove_digits": True})
    assert o.remove_stop_words and o.lemmatize and o.remove_digits and o.remove_versions and not o.genitive
    with pytest.raises(ValueError):
        clean.service_options({"nonsense": True})


def test_pipeline_order(spark):
    text = "The server's file /etc/passwd, see CVE-2020-12345 (old). Go to https://x.y now; it's v1.2 1.2"
    o = clean.CleanOptions(remove_versions=True, remove_entities=True, expand_contractions=True, remove_stop_words=True)
    got = clean.clean_text(spark.createDataFrame([(text,)], "t string"), "t", "t", o).first()["t"]
    assert got == "file server etc passwd see old go it.2"  # the genitive step runs before versions and contractions


def test_null_and_blank_requests(spark, rows):
    cves = spark.createDataFrame([("a", "Some text 1.2"), ("b", "  "), ("c", None)], "id string, description string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "cve_id string")
    got = {r["cve_id"]: (r["text"], r["error"]) for r in clean.clean_requested(asked, cves).collect()}
    assert got == {"a": ("some text", None), "b": (None, "no valid description"), "c": (None, "no valid description"), "d": (None, "not found")}


def test_versions_build_on_each_other(spark):
    df = spark.createDataFrame([(1, "the vulnerabilities of servers", ["is running"])], "id int, a string, b array<string>")
    got = {r["preprocessed_version"]: (r["a"], r["b"]) for r in clean.cumulative_versions(df, ("a",), ("b",)).collect()}
    assert got == {
        "Basic": ("the vulnerabilities of servers", ["is running"]),
        "Stopwords": ("vulnerabilities servers", ["running"]),
        "Lemmatization": ("vulnerability server", ["running"]),
        "Stemming": ("vulner server", ["run"]),
    }


def test_lexicon_ways_agree_on_odd_tables(spark):
    texts = spark.createDataFrame([(1, "foo bar e\u0301 t"), (1, "foo"), (None, "baz foo")], "id int, t string")
    table = spark.createDataFrame([("foo", "f2"), ("foo", "f1"), ("bar", None), ("baz", "b"), (None, "x")], "token string, lemma string")
    small, large = (clean.lemmatize_with_lexicon(texts, "id", "t", "o", table, **o) for o in ({}, {"limit": 0}))
    key = lambda r: (r["t"], r["o"])
    assert sorted(map(key, small.collect())) == sorted(map(key, large.collect()))
    assert ("foo", "f1") in map(key, large.collect()) and small.columns == large.columns


def test_version_starts_cover_all_phrases():
    assert T.first_character(r"(\d+)x") == r"\d" and T.first_character("CVE") == "c"
    with pytest.raises(ValueError):
        T.first_character("v?x")


def test_lexicon_table_both_ways(spark, rows):
    texts = spark.createDataFrame([(1, "mice ran, mice hid"), (2, ""), (3, None)], "id int, t string")
    table = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "token string, lemma string")
    small = clean.lemmatize_with_lexicon(texts, "id", "t", "o", table)
    large = clean.lemmatize_with_lexicon(texts, "id", "t", "o", table, limit=0)
    want = {1: "mouse run , mouse hid", 2: "", 3: None}
    assert {r["id"]: r["o"] for r in small.collect()} == want
    assert {r["id"]: r["o"] for r in large.collect()} == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aB1é .,-/()\nhttp:CVE-20", max_size=60))
def test_steps_are_idempotent(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    steps = [T.lowercase, T.remove_digits, T.remove_space_newline, T.remove_special_characters]
    once = df.select(*[s(F.col("t")).alias(f"c{i}") for i, s in enumerate(steps)])
    twice = once.select(*[s(F.col(f"c{i}")).alias(f"c{i}") for i, s in enumerate(steps)])
    assert once.first() == twice.first()
    assert not re.search(r"\d", once.first()["c1"])


def test_text_rules_in_pieces(spark, monkeypatch):
    """Rules see every text of a batch, whatever its pieces; null stays null, empty stays empty."""
    monkeypatch.setattr("corrspark.functions.pieces.PIECE_BYTES", 20)
    texts = ["two cats", None, "", "boxes " * 40, "dogs"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    got = {r["i"]: (r["l"], r["s"]) for r in df.select("i", clean.lemmatize_text(F.col("t")).alias("l"), clean.stem_text(F.col("t")).alias("s")).collect()}
    assert got == {0: ("two cat", "two cat"), 1: (None, None), 2: ("", ""), 3: (" ".join(["box"] * 40),) * 2, 4: ("dog", "dog")}


def test_words_remembered_per_worker_are_few():
    from corrspark.functions import words as W

    assert all(f.cache_info().maxsize <= 1 << 16 for f in (W.stem, W.noun_lemma))


def test_tokens_and_blanks_without_lists(spark):
    import random
    import re

    pick = random.Random(5)
    texts = ["".join(pick.choice("aé1_.'- \n\t\u00a0;,!") for _ in range(pick.randrange(0, 25))) for _ in range(400)] + ["", None, "a.b.-c", " .a'b. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.advanced_tokenization(F.col("t")).alias("w"), T.collapse_all(F.col("t")).alias("c"), T.remove_space_newline(F.col("t")).alias("n")).collect()
    for r in got:
        if r["t"] is None:
            assert r["w"] is None and r["c"] is None and r["n"] is None
            continue
        assert r["w"] == " ".join(re.findall(r"\w+(?:[.'\-]\w+)*", r["t"]))
        assert r["c"] == re.sub(r"\s+", " ", r["t"]).strip()
        assert r["n"] == re.sub(r"\s{2,}", " ", re.sub(r"[\n\t\r]", " ", r["t"])).strip()
    assert "regexp_extract_all" not in str(T.advanced_tokenization(F.col("t")))
