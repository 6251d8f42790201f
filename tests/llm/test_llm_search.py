"""Operators 11 to 13: collocations, personal data and lexical search, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import awkward, frame, prose

from corrspark.llm import collocations, lexical_search, pii

LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- lexical search ----------------------------------------------------------


def brute_search(docs, items, top):
    tokens = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    tokens = [(i, w) for i, w in tokens if w]
    n_docs, n_terms = len(tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, w in tokens:
            tf, m, score = Counter(w), 50 + 50 * len(w) * n_docs // n_terms, 0
            for t in asked & set(tf):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def search_rows():
    docs = [(r[0], r[1]) for r in awkward()]
    pick = random.Random(5)
    docs += [(1000 + i, prose(i % 70, pick.choice([1, 5, 60, 300]))) for i in range(150)]
    items = [(1, "The ING and"), (2, prose(3, 40)), (3, None), (4, "!!"), (5, "absent-word"), (6, "née élan 你好"), (2, "one the"), (7, prose(1, 200)), (8, "tail words here")]
    return docs, items


@pytest.mark.parametrize(("rows", "size", "item_bytes"), [(7, 1 << 20, 1 << 20), (64, 20_000, 600), (4096, 1 << 23, 1 << 20)])
def test_search_equals_brute_force(spark, rows, size, item_bytes):
    docs, items = search_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = lexical_search.search(d, q, 12, item_bytes, rows, size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(docs, items, 12)


def test_search_of_empty_tables(spark):
    docs, items = search_rows()
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(none, asked).count() == 0
    some = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical_search.search(some, asked.where("item_id < 0")).count() == 0
    assert lexical_search.search(some, asked.where("item_id = 4")).count() == 0


def test_tree_keeps_every_cell_and_maximum():
    pick = np.random.default_rng(3)
    cells = np.unique(pick.integers(0, 50 * 33, 300))
    row, col, impact = cells // 33, cells % 33, pick.integers(1, 10**6, len(cells))
    masks, tops = lexical_search.squares(row, col, impact, 6)
    treap = lexical_search.Treap([len(t) for t in tops], *lexical_search.packed(masks, tops))
    want = {(int(r), int(c)): int(i) for r, c, i in zip(row, col, impact, strict=True)}
    found, stack = {}, [(0, 0, 0, 0)]
    while stack:
        node, level, r, c = stack.pop()
        inside = [i for (a, b), i in want.items() if a >> (6 - level) == r and b >> (6 - level) == c]
        assert treap.top[node] == max(inside)
        if level == 6:
            found[r, c] = int(treap.top[node])
            continue
        for q in range(4):
            child = int(treap.child(np.array([node]), np.array([q]))[0])
            if child != treap.none:
                stack.append((child, level + 1, 2 * r + q // 2, 2 * c + q % 2))
    assert found == want


def test_equal_scores_go_by_id_and_copies_are_kept(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)]
    got = lexical_search.search(frame(spark, [(i, t, None, None, None) for i, t in docs], 5), spark.createDataFrame([(1, "words")], "item_id long, text string"), 10)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(1, 11))


# --- collocations ------------------------------------------------------------


def brute_phrases(rows, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        scored = []
        for p, a in cand.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            s, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows(seed):
    pick = random.Random(seed)
    words = ["the", "of", "Of", "née", "x" * 300, "a", "b", "c", "d"]
    rows = [(pick.choice(["en", "fr", None, "und"]), " ".join(pick.choice(words) + pick.choice(["", "", "", ".", "\n", "\t", ","]) for _ in range(pick.randrange(0, 90)))) for _ in range(80)]
    return rows + [("en", "a very common passage of words that all share")] * 60 + [(r[2], r[1]) for r in awkward()]


@pytest.mark.parametrize(("least", "budget", "groups"), [(2, 4_000_000, 256), (3, 50, 4), (5, 4_000_000, 1)])
def test_collocations_equal_brute_force(spark, least, budget, groups):
    rows = phrase_rows(least)
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n long, phrase string").repartition(4)
    got = collocations.collocations(df, least, 80, 40, budget, groups)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, 80, 40)


def test_collocations_of_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", ""), ("en", " . ")], "lang string, text string")
    assert collocations.collocations(blank).count() == 0


def test_groups_stay_within_their_load():
    totals = {b: 1 + b % 97 for b in range(5_000)}
    group = collocations.pack(totals, 16)
    loads = Counter()
    for b, n in totals.items():
        loads[int(group[b])] += n
    assert max(loads.values()) - min(loads.values()) <= 97


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (
                kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15))
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def card(pick):
    digits = "4" + "".join(pick.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def personal_rows():
    pick = random.Random(8)
    pieces = [
        lambda: f"jo.{pick.randrange(99)}@mail{pick.randrange(9)}.example.com", lambda: ".".join(str(pick.randrange(0, 300)) for _ in range(pick.choice([2, 4, 4, 5, 8]))),
        lambda: card(pick), lambda: re.sub("(....)(?=.)", pick.choice([r"\1 ", r"\1-", r"\1."]), card(pick)), lambda: str(pick.randrange(10**15, 10**16)),
        lambda: f"+1 ({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}", lambda: f"({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}",
        lambda: "%x" % pick.getrandbits(160), lambda: "a@b.c_d@e.f", lambda: "+12(", lambda: "née \U0001f600", lambda: "1  2", lambda: "+" + "1" * pick.randrange(1, 20), lambda: "x@y", lambda: "000.0.0.0001",
    ]
    rows = []
    for i in range(250):
        rows.append((i, " ".join(pick.choice(pieces)() if pick.random() < 0.15 else prose(pick.randrange(10**6), 2) for _ in range(pick.randrange(0, 60)))))
    edge = ["1" * 30_000, "1.1." * 5_000, "1 " * 9_000, "a@" * 4_000, "a" * 50_000, "+1" * 4_000, "@", "+", "x" * 9_000 + "@y.z", "4 " * 15_000 + "@", "a.b@c.d" * 500]
    return rows + [(1000 + i, t) for i, t in enumerate(edge)] + [(None, "jo@x.org"), (7, "jo@x.org"), (7, "jo@x.org"), (2000, None), (2001, "")]


def test_base_spans_equal_brute_force_and_stay(spark):
    rows = personal_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, start int").repartition(3)
    got = pii.digest(pii.spans(df))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for i, text in rows:
        base = brute_spans(text)
        counts = Counter(s.split(":")[0] for s in base)
        want.append((i, counts["email"], counts["ip"], counts["card"], counts["phone"], hashlib.sha256(",".join(base).encode()).hexdigest()))
    have = got.collect()
    assert sorted((tuple(r)[:6] for r in have), key=repr) == sorted(want, key=repr)
    texts = {i: t for i, t in rows if i is not None and i != 7}
    order = {k: n for n, k in enumerate(pii.KINDS)}
    for r in have:
        found = [s for s in r["spans"].split(",") if s]
        keys = [(order[s.split(":")[0]], int(s.split(":")[1])) for s in found]
        assert keys == sorted(keys)
        if r["doc_id"] in texts:
            assert set(brute_spans(texts[r["doc_id"]])) <= set(found)


def learning_rows():
    pick = random.Random(21)
    rows = []
    for i in range(900):
        words = prose(i, 30).split()
        kind = i % 6
        if kind == 0:
            words.insert(9, f"+1 ({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}")
        elif kind == 1:
            words.insert(5, re.sub("(....)(?=.)", r"\1" + pick.choice(["", " ", "-"]), card(pick)))
        elif kind == 2:
            words.insert(5, f"jo.{i}@mail{i % 9}.example.com")
        elif kind == 3:
            words.insert(5, f"token = {pick.getrandbits(160):x} {pick.randrange(10**15, 10**16 - 1)}")
        elif kind == 4:
            words.insert(5, f"version {pick.randrange(9)}.{pick.randrange(9)} of 20{pick.randrange(10, 25)}-0{pick.randrange(1, 9)}-11 and user@host")
        rows.append((i, " ".join(words)))
    return rows


def test_trees_add_other_spellings_and_leave_clean_texts(spark):
    extra = [(5001, "call me at 1 (415) 555-0134 or so"), (5002, "pay with 4539.1488.0343.6467 now"), (5003, "nothing of 2021-03-11 in version 4.0 here"), (5004, "write to 12 people")]
    df = spark.createDataFrame(learning_rows() + extra, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.spans(df)).collect()}
    assert got[5002] == "card:9:28"
    assert got[5003] == "" and got[5004] == ""
    clean = [i for i, t in learning_rows() if i % 6 in (4, 5)]
    assert all(got[i] == "" for i in clean)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert texts[5002] == "pay with [card] now" and texts[5004] == extra[3][1]
    assert "[email]" in texts[2] and "@" not in texts[2]


def test_personal_data_of_awkward_and_empty_tables(spark):
    rows = awkward()
    got = pii.digest(pii.spans(frame(spark, rows, clashes=True))).collect()
    assert len(got) == len(rows) and all(r["spans"] == "" for r in got)
    assert pii.digest(pii.spans(frame(spark, rows).where("false"))).count() == 0
    assert pii.redact(frame(spark, rows, clashes=True)).count() == len(rows)
