"""Operators 2, 9 and 10: word based, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import awkward, frame, prose

from corrspark.llm import decontaminate, near_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed):
    """Chains and clusters of edited texts, exact copies, and a passage that many share."""
    pick = random.Random(seed)
    rows, passage = [], prose(seed + 9, 60).split()
    for base in range(12):
        words = prose(seed * 100 + base, pick.choice([3, 8, 40, 150])).split()
        for _ in range(pick.randrange(1, 14)):
            rows.append(" ".join(words).upper() if pick.random() < 0.2 else "\n".join(words))
            for _ in range(max(1, len(words) // pick.choice([20, 40, 60]))):
                words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
    rows += [" ".join(prose(seed * 7 + i, 90).split() + passage) for i in range(15)]
    ids = pick.sample(range(1000), len(rows))
    return [*zip(ids, rows, strict=True), (2000, None), (2001, ""), (2002, " \n "), (2003, "solo"), (2004, "SOLO")]


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, width):
    rows = near_rows(seed)
    want = brute_components(rows, width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, width=width).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_pairs_that_no_pivot_settles_are_compared(spark):
    rows = near_rows(3)
    want = brute_components(rows, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # wide buckets (one row per band) hold many texts that are not alike; one pivot only
    got = near_dedup.near_duplicates(df, bands=24, rows=1, pivots=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_awkward(spark):
    got = near_dedup.near_duplicates(frame(spark, awkward(), clashes=True)).collect()
    assert len(got) == len(awkward())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["kept"] and by_id[2]["component_id"] == 2
    assert by_id[7]["component_id"] == 6 and by_id[8]["component_id"] == 6 and not by_id[8]["kept"]
    assert by_id[14]["kept"] and by_id[None]["component_id"] is None
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(20)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "u long, v long").where("u <> v")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(20)) and got[301] == 300


def brute_contained(docs, items, width=5, percent=80):
    def words(t):
        return WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", "", t or "").translate(LOWER))

    out = {}
    for item, text in items:
        w = words(text)
        k = min(width, len(w))
        own = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc, t in docs:
            d = words(t)
            have = own & {tuple(d[i:i + k]) for i in range(len(d) - k + 1)}
            if own and 100 * len(have) >= percent * len(own):
                out[doc, item] = (len(own), len(have))
    return out


def test_contained_equals_brute_force(spark, monkeypatch):
    pick = random.Random(2)
    items = [(i, prose(900 + i, pick.choice([1, 3, 5, 6, 20, 45, 130]))) for i in range(40)] + [(90, None), (91, ""), (92, prose(901, 45) + ".")]
    docs = [(0, None), (1, ""), (2, "the")]
    for i in range(60):
        parts = prose(i, 400).split()
        for _, text in pick.sample(items[:40], 3):
            w = text.upper().split()
            for _ in range(pick.randrange(0, 4)):
                w[pick.randrange(len(w))] = "other"
            cut = pick.randrange(len(w))
            parts[10:10] = [x + pick.choice(["", "", ",", "."]) for x in w[:cut]]
            parts[pick.choice([10 + cut, 10 + cut, 200]):0] = []
            at = pick.choice([10 + cut, 10 + cut, 300])
            parts[at:at] = w[cut:]
        docs.append((10 + i, "\n".join(parts)))
    want = brute_contained(docs, items)
    assert len(want) > 50
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    read = lambda df: {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_shared"]) for r in df.collect()}
    assert read(decontaminate.contained(d, q)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 300)
    assert read(decontaminate.contained(d, q)) == want  # several blocks
    kept = {r["doc_id"] for r in decontaminate.clean(d, q).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_clean_keeps_columns_and_awkward_rows(spark):
    docs = frame(spark, awkward(), clashes=True)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(awkward()) and decontaminate.contained(docs, none).count() == 0
    out = decontaminate.clean(docs, spark.createDataFrame([(1, prose(2, 50))], "item_id long, text string"))
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in awkward()} - {9, 10}


def test_sketch_length_leaves_no_gap():
    index = decontaminate.Index([], 80)
    for n in range(1, 400):
        lacking = n - -(-n * 80 // 100)  # most hashes that a match may lack
        assert index.sketch_length(n) > lacking


def test_items_are_searched_by_size_class(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 5, np.unique(rng.integers(0, 2**63, n, np.uint64))) for i, n in enumerate((1, 2, 3, 4, 5, 8, 9, 64, 65, 700))]
    index = decontaminate.Index(rows + [(99, 2, np.array([7], np.uint64))], 80)
    assert [(c.width, c.largest) for c in index.classes] == [(2, 1), (5, 1), (5, 2), (5, 4), (5, 8), (5, 16), (5, 64), (5, 128), (5, 1024)]
    for c in index.classes:
        assert all(c.largest // 2 < len(index.sets[i]) <= c.largest for i in set(c.owners.tolist()))
        assert all((c.owners == i).sum() == min(c.sketch, len(index.sets[i])) for i in set(c.owners.tolist()))
    long = np.unique(np.concatenate([rows[9][2], rows[4][2], rng.integers(0, 2**63, 5000, np.uint64)]))
    assert [c.candidates([long[:0], long]) for c in index.classes if c.largest in (8, 1024)] == [[(1, 4)], [(1, 9)]]


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_equal_brute_force(spark):
    rows = [r for r in awkward() if r[0] not in (None, 14)]
    rows += [(500, "a b c a b c", "en", "s", 1), (501, "a a a a", "en", "s", 1), (502, "a a a", "en", "s", 1), (503, "a b\na b\n\n \na b", "en", "s", 1), (504, "word " * 60, "en", "s", 1)]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows, clashes=True)).collect()}
    for doc_id, text, *_ in rows:
        r, want = got[doc_id], brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, doc_id
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[9]["kept"] and not got[504]["kept"]
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_ablations_from_the_histogram(spark):
    book = quality_rules.ledger(frame(spark, awkward()))
    mask = quality_rules.POLICIES[quality_rules.CURRENT]
    failed = [r["failed"] & mask for r in book.collect()]
    got = {r["rule"]: r for r in quality_rules.ablations(quality_rules.histogram(book), mask).collect()}
    assert set(got) == set(quality_rules.RULES)
    for name, bit in quality_rules.BIT.items():
        assert got[name]["n_failed"] == sum(f & bit > 0 for f in failed)
        assert got[name]["n_failed_alone"] == sum(f == bit for f in failed)
        assert got[name]["n_kept_without"] == sum(f & ~bit == 0 for f in failed)
    assert quality_rules.ablations(quality_rules.histogram(book), 0).count() == 0


def test_verdicts_name_the_rule_that_decides(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["few words", "word " * 60, prose(2, 80), prose(3, 80).upper(), "few other words"])]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows, clashes=True)).collect()}
    inside = quality_rules.POLICIES[quality_rules.CURRENT]
    alone = {i: next((n for n, b in quality_rules.BIT.items() if r["failed"] & inside == b), None) for i, r in got.items()}
    assert {i: r["decided_by"] for i, r in got.items()} == alone and alone[0] == "few_words" and alone[3] == "shouting"
    n = Counter(alone.values())
    assert all(r["n_decided"] == (n[alone[i]] if alone[i] else None) for i, r in got.items())


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_crafted_words_do_not_meet(spark):
    """Two words that any polynomial modulo 2 ** 64 hashes alike share nothing."""
    first = thue_morse(1024)
    other = first.translate({97: 98, 98: 97})
    rows = [(1, f"w x y {first}"), (2, f"w x y {other}"), (3, f"z w x y {first}"), (4, first), (5, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (n, c) for i, (n, c) in brute_components(rows, 4).items()}
    items = spark.createDataFrame([(1, f"v w x y {other}"), (2, f"z w x y {first}"), (3, other)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(df, items).collect()} == {(3, 2), (2, 3), (5, 3)}
