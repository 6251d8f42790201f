"""Operators 4 and 7: trained models against direct definitions and held-out rows."""

import itertools
import math
import random
import zlib

import pytest
from llm_cases import awkward, frame, prose

from corrspark.llm import language_id, lm_score

FOLDER = "/root/testdata/sf0.001"


def brute_parse(data: bytes, source: bytes) -> int:
    n = at = 0
    while at < len(data):
        size = 1
        while at + size < len(data) and data[at:at + size + 1] in source:
            size += 1
        n, at = n + 1, at + size
    return max(n, 1)


def test_phrases_are_greedy_longest_matches():
    source, text = language_id.normal(prose(1, 200)), language_id.normal(prose(2, 60) + " xyz 123 née")
    model = language_id.build({"a": prose(1, 200)})
    parsed = text.translate(model.alphabet)
    known = source.translate(model.alphabet)
    assert language_id.phrases(parsed, model.automata[0].steps) == brute_parse(parsed, known)
    assert language_id.phrases(known, model.automata[0].steps) == 1


def test_language_by_text_alone(spark):
    rows = [(i, f"der und nicht sich ein {prose(i, 3)} für über", "de", "s", 1) for i in range(40)]
    rows += [(100 + i, f"the of and that with {prose(i, 3)} which have", "en", "s", 1) for i in range(40)]
    docs = frame(spark, rows)
    model = language_id.fit(docs)
    probe = [(1, "der und nicht für", "en", None, 0), (2, "the of and have", None, None, 0), (3, None, "en", None, 0), (4, "12 ?!", "en", None, 0), (5, "", "de", None, 0)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, probe, clashes=True), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["held_out"] for i in range(1, 6)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 6)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_language_awkward(spark):
    docs = frame(spark, awkward(), clashes=True)
    model = language_id.fit(docs)
    assert language_id.identify(docs, model).count() == len(awkward())
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {4, 6, 9, 14, None} and not {1, 2, 3, 5} & {r["doc_id"] for r in kept.collect()}
    empty = frame(spark, [])
    none = language_id.fit(empty)
    assert language_id.identify(empty, none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def many_languages(n: int) -> list[tuple]:
    """``n`` languages of made-up words, 12 texts each but 30 of the first; the last has its own script."""
    rows = []
    for k in range(n):
        pick = random.Random(k)
        letters = "абвгдежзиклмнопрстуф" if k == n - 1 else "abcdefghijklmnopqrstuvwxyz"
        words = ["".join(pick.choice(letters) for _ in range(pick.randint(3, 7))) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(pick.choice(words) for _ in range(60)), f"l{k:02d}", "s", 1) for i in range(30 if k == 0 else 12)]
    return rows


@pytest.mark.parametrize("block_bytes", [language_id.BLOCK_BYTES, 2_000_000])
def test_every_label_is_learned(spark, block_bytes):
    docs = frame(spark, many_languages(36) + [(99_999, None, "l00", "s", 1)], clashes=True)
    samples = language_id.fit(docs, block_bytes=block_bytes)
    assert sorted(samples.texts) == [f"l{k:02d}" for k in range(36)]
    assert (len(samples.blocks()) > 3) == (block_bytes < language_id.BLOCK_BYTES)
    got = language_id.identify(docs, samples).collect()
    assert len(got) == len(many_languages(36)) + 1
    want = {r[0]: r[2] for r in many_languages(36)}
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) if r["doc_id"] == 99_999 else r["lang_pred"] == want[r["doc_id"]] for r in got)
    kept = language_id.keep_known(docs, samples)
    assert kept.columns == docs.columns and kept.count() == len(many_languages(36))


def test_a_label_of_a_few_letters_takes_nothing(spark):
    english = "the of and that with have which from this were been their would there could other about"
    rows = []
    for i in range(60):
        pick = random.Random(i)
        rows.append((i, " ".join(pick.choice(english.split()) for _ in range(80)), "en", "s", 1))
    given = len(rows)
    tiny = [(1000 + 4 * i + j, text, name, "s", 1) for i, (name, text) in enumerate([("aa", "ok"), ("ab", "hello"), ("ac", "the")]) for j in range(4)]
    russian = [(5000, "съешь же ещё этих мягких французских булок", None, "s", 1)]
    docs = frame(spark, rows + tiny + russian)
    samples = language_id.fit(docs)
    assert set(samples.texts) == {"en", "aa", "ab", "ac"}
    got = {r["doc_id"]: r for r in language_id.identify(docs, samples).collect()}
    assert {got[i]["lang_pred"] for i in range(given)} == {"en"}
    assert got[5000]["bits_per_byte"] > language_id.REJECT_BITS
    kept = {r["doc_id"] for r in language_id.keep_known(docs, samples).collect()}
    assert set(range(given)) <= kept and 5000 not in kept
    only = language_id.fit(frame(spark, tiny))
    assert {r["doc_id"] for r in language_id.keep_known(frame(spark, russian), only).collect()} == set()


def test_samples_are_bounded_by_bytes_alone(spark):
    docs = frame(spark, [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "s", 1) for i in range(600)] + [(9000 + i, prose(i, 2_000), "fr", "s", 1) for i in range(8)])
    samples = language_id.fit(docs, sample_bytes=6_000)
    learned = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(samples.texts["en"].split()) == len(learned)
    assert 5_990 <= len(samples.texts["fr"]) <= 6_000


def segmentations(text, pieces):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield (text[:n], *rest)


def small_lattice():
    weights = {"▁": 0.2, "a": 0.1, "b": 0.1, "ab": 0.15, "▁a": 0.2, "ba": 0.05, "bab": 0.02, "<0xC3>": 0.09, "<0xA9>": 0.09}
    return weights, lm_score.Lattice({p: math.log(w) for p, w in weights.items()} | {f"<0x{b:02X}>": math.log(1e-6) for b in range(256) if f"<0x{b:02X}>" not in weights})


@pytest.mark.parametrize("word", ["a", "ab", "abab", "babbab", "aabbaabb"])
def test_lattice_sums_all_segmentations(word):
    weights, lattice = small_lattice()
    every = list(segmentations("▁" + word, weights))
    total = sum(math.prod(weights[p] for p in s) for s in every)
    assert lattice.log_probability(word) == pytest.approx(math.log(total))
    use = [0.0] * len(lattice.names)
    lattice.expect(word, 3.0, use)
    for i, name in enumerate(lattice.names):
        want = sum(math.prod(weights[p] for p in s) * s.count(name) for s in every) / total
        assert use[i] == pytest.approx(3 * want)


def test_expectation_of_a_very_long_word_is_taken_in_log_space():
    _, lattice = small_lattice()
    short, long = ([0.0] * len(lattice.names) for _ in range(2))
    lattice.expect("ab" * 50, 1.0, short)
    lattice.expect("ab" * 3_000, 1.0, long)
    letters = lambda use: sum(u * len(n.replace("▁", "")) for u, n in zip(use, lattice.names, strict=True) if not n.startswith("<"))
    assert letters(short) == pytest.approx(100) and letters(long) == pytest.approx(6_000)


def test_lattice_falls_back_to_bytes_and_takes_long_words():
    weights, lattice = small_lattice()
    assert lattice.log_probability("é") == pytest.approx(math.log(weights["▁"] * 0.09 * 0.09))
    assert math.isfinite(lattice.log_probability("ab" * 5_000))
    assert math.isfinite(lattice.log_probability("\U0001f600"))


def direct(rows):
    """Base score by its definition."""
    counts: dict = {}
    trained = {i: t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    for t in trained.values():
        for w in [*lm_score.tokens(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        words = [*lm_score.tokens(t), None]
        out[i] = (len(words), sum(counts.get(w, 0) > 0 for w in words), n, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    return out


def test_base_score_and_frequent_words_do_not_matter(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] not in (None, 14, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, seen = direct(rows), []
    for frequent in (100_000, 4, 0):
        got = {r["doc_id"]: r for r in lm_score.score(docs, frequent=frequent).collect()}
        for i, (n, known, total, base) in want.items():
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
            assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] < 0
            assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        seen.append({i: r["score"] for i, r in got.items()})
    for a, b in itertools.pairwise(seen):
        assert all(a[i] == pytest.approx(b[i]) for i in a)


def test_score_is_the_sum_over_words(spark):
    rows = [(i, prose(i, 30)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
    again = {r["doc_id"]: r["score"] for r in lm_score.score(docs.union(docs.where("doc_id = 3"))).collect()}
    assert len(again) == 20 and once.keys() == again.keys()
    shuffled = [(i, " ".join(reversed(t.upper().split()))) for i, t in rows]
    turned = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(shuffled, "doc_id long, text string")).collect()}
    assert all(once[i] == pytest.approx(turned[i]) for i in once)


def test_training_raises_the_likelihood_of_its_text(spark):
    words = spark.createDataFrame([(b"thetion", 50, 50), (b"andering", 20, 20)], "word binary, c long, n long")
    before = lm_score.read_vocabulary()
    after = lm_score.train(words, before)
    assert sum(map(math.exp, after.values())) == pytest.approx(1, abs=1e-6)
    assert lm_score.Lattice(after).log_probability("thetion") > lm_score.Lattice(before).log_probability("thetion")


def test_score_awkward(spark):
    got = lm_score.score(frame(spark, awkward(), clashes=True), frequent=3).collect()
    assert len(got) == len(awkward())
    assert all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)
    repeated = [r for r in got if r["doc_id"] == 14]
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    assert lm_score.score(frame(spark, [])).count() == 0
