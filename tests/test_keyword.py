"""The indexed keyword pass against a pair-by-pair brute force."""

import re
import random

import pytest

from corrspark import lexicon
from corrspark.functions import words as W
from corrspark.operators import keyword
from test_similarity import half_up


def longest_run(kw, text):
    best = 1
    for i in range(len(kw)):
        for j in range(len(text)):
            n = 0
            while i + n < len(kw) and j + n < len(text) and kw[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
    return best


def pair_score(normal, kw, text):
    """Score of one keyword and one text, straight from the rules."""
    k, k_stems = normal(kw)
    t, t_stems = normal(text)
    if k and k in t:
        return 0.3
    if not k_stems:
        return 0.0
    joined = " ".join(t_stems)
    if " ".join(k_stems) in joined:
        return 0.3
    n = len(k_stems)
    found = sum(w in t_stems for w in k_stems)
    run = longest_run(k_stems, t_stems)
    # each further word of a run adds one more share of the bonus
    bonus = sum(0.05 / n * step for step in range(1, run))
    score = 0.2 / n * found + min(0.05, bonus)
    if n >= 4 and (" ".join(k_stems[: n // 2]) in joined or " ".join(k_stems[n // 2 :]) in joined):
        return score + 0.15
    return score + (0.1 if found >= 2 else 0)


def brute(normal, texts, keywords):
    out = {}
    for tid, text in texts:
        for pid, kw in keywords:
            out[tid, pid] = max(out.get((tid, pid), 0.0), pair_score(normal, kw, text))
    return {k: (half_up(v) if v else -0.01) for k, v in out.items()}


@pytest.fixture
def normal():
    return keyword.Normaliser(lexicon.STOPWORDS, lexicon.ACRONYMS, W.noun_lemma, W.stem)


def corpus(seed):
    draw = random.Random(seed)
    pool = "sql injection attack the of server files running cross site scripting buffer overflow dos users request forged xss".split()
    text = lambda a, b: " ".join(draw.choices(pool, k=draw.randint(a, b)))
    texts = [(f"t{i}", text(0, 40)) for i in range(40)]
    keywords = [(f"CAPEC-{i % 9}", text(1, 7)) for i in range(25)]
    return texts, keywords


@pytest.mark.parametrize("limit", [1 << 27, 4 << 10])
def test_matches_brute_force(spark, normal, limit):
    texts, keywords = corpus(3)
    df = keyword.keyword_scores(
        spark.createDataFrame(texts, "cve_id string, text string"),
        spark.createDataFrame(keywords, "capec_id string, keyword string"), limit=limit,
    )
    got = {(r["cve_id"], r["capec_id"]): r["keyword_score"] for r in df.collect()}
    want = brute(normal, texts, keywords)
    assert got == want


CASES = [
    ("SQL Injection", "a sql injection here", 0.3),
    ("Running servers", "the server runs", 0.3 - 0.3 + 0.2 + 0.1),  # both stems, no run
    ("Overflow of buffers", "buffer overflow", 0.2 + 0.1),
    ("alpha beta gamma delta", "x gamma delta y", 0.2 / 4 * 2 + 0.05 / 4 + 0.15),  # second half, run at the end
    ("alpha beta gamma", "alpha beta", 0.2 / 3 * 2 + 0.05 / 3 + 0.1),
    ("alpha beta", "alpha only", 0.1),
    ("of the", "no match of words", None),
    ("nothing shared", "other words", None),
    ("XSS", "uses cross site scripting (XSS)", 0.3),
]


@pytest.mark.parametrize("kw,text,want", CASES)
def test_rules(normal, kw, text, want):
    import pandas as pd


    uni = lambda s: " ".join(s.lower().replace("(", " ").replace(")", " ").split())
    rows = pd.DataFrame({"capec_id": ["p"], "uniform": [uni(kw)]})
    index = keyword.KeywordIndex(rows, normal, keyword.STAGES, False)
    got = index.scores(uni(text)).get(0)
    assert got == (None if want is None else pytest.approx(want))


def test_compat_counts_empty_keywords(normal):
    import pandas as pd

    rows = pd.DataFrame({"capec_id": ["p"], "uniform": ["of the"]})
    assert keyword.KeywordIndex(rows, normal, keyword.STAGES, True).scores("anything") == {0: 0.3}


def test_finder_without_automaton():
    needles = [("ab", 0), ("b", 1), ("zz", 2), ("ab", 3)]
    fast, slow = keyword.Finder(needles), keyword.Finder(needles)
    slow.automaton = None
    assert fast("xaby") == slow("xaby") == {0, 1, 3}


def test_title_score():
    assert keyword.fuzzy_title_score("SQL injection", "a sql injection") == 0.3
    assert keyword.fuzzy_title_score("alpha beta", "alpha gamma") == pytest.approx(0.15 + 0.1)
    assert keyword.fuzzy_title_score("server one two three", "servre one") == pytest.approx(0.3 / 4 + 0.15 / 4 + 0.05)


def test_hits_in_pieces_and_blocks_agree(spark, monkeypatch):
    """Batches cut into pieces, one block or many, null texts and repeated keys: the same scores."""
    texts, keywords = corpus(3)
    texts = [*texts, texts[0], (None, "sql injection"), ("t77", None), ("t78", "")]
    df = spark.createDataFrame(texts, "cve_id string, text string").repartition(1)
    kw = spark.createDataFrame(keywords, "capec_id string, keyword string")
    collect = lambda limit: sorted((str(r[0]), r[1], r[2]) for r in keyword.keyword_scores(df, kw, limit=limit).collect())
    whole = collect(1 << 27)
    assert len(whole) == len(texts) * len({p for p, _ in keywords})
    monkeypatch.setattr("corrspark.operators.blocks.ARROW_CELLS", 7)
    assert collect(1 << 27) == whole and collect(1 << 10) == whole


def test_fuzzy_title_compares_words_of_fitting_length_only(monkeypatch):
    """The score is that of all comparisons, and lengths rule most of them out."""
    draw, asked, plain = random.Random(5), [], W.ratio
    word = lambda: "".join(draw.choices("abc", k=draw.randint(1, 12)))
    monkeypatch.setattr(W, "ratio", lambda a, b: asked.append((a, b)) or plain(a, b))
    for _ in range(200):
        title, text = (" ".join(word() for _ in range(k)) for k in (4, 12))
        got = keyword.fuzzy_title_score(title, text, stem=str)
        names, pool = title.split(), set(text.split())
        if title in text:
            continue
        hit = sum(n in pool for n in names)
        near = sum(n not in pool and max(plain(n, b) for b in pool) > 80 for n in names)
        share = hit / 4
        assert got == pytest.approx(hit * 0.3 / 4 + near * 0.15 / 4 + (0.1 if 0.5 <= share < 0.75 else 0.05 if 0.25 <= share < 0.5 else 0.0))
    assert asked and all(round(200 * min(len(a), len(b)) / (len(a) + len(b))) > 80 for a, b in asked)


def test_a_word_is_brought_to_its_stem_once():
    import pickle

    asked = []
    normalise = keyword.Normaliser(["the"], {}, None, lambda t: asked.append(t) or t.lower() + "_")
    want = ("The a.b-c x, a.b-c the x,".lower(), ["a.b-c_", "x_", ",_", "a.b-c_", "x_", ",_"])
    assert normalise("The a.b-c x, a.b-c the x,") == want and normalise("The a.b-c x, a.b-c the x,") == want
    assert asked == ["a.b-c", "x", ","]
    whole = keyword.Normaliser(["the"], {}, None, None)
    whole("some words")
    assert not pickle.loads(pickle.dumps(whole)).known


def test_acronyms_inside_of_words_are_not_looked_up():
    rule = keyword.Acronyms({"SOC": ["Security Center"], "C+": ["C Plus"]})
    for text in ("a social soc", "social", "soc", "xsoc soc_ soc1", "security center socx", "security center soc", "sociAL \u017foc", "soc\u00e9", "\u00e9 soc"):
        want = text
        for acronym, full in (("SOC", "Security Center"),):
            want = re.sub(rf"(?i)\b{acronym}\b", full, re.sub(rf"(?i)\b{full}\s+{acronym}\b", full, want)) if acronym.lower() in want.lower() else want
            want = re.sub(rf"(?i)\b{full}\b", acronym, want) if full.lower() in want.lower() else want
        assert rule(text) == want, text
    assert not rule._may_stand("soc", "social soc_") and rule._may_stand("soc", "social soc")
