"""Operator 1 against a brute-force search, and its parts."""

import hashlib
import random

import numpy as np
import pytest
from llm_cases import awkward, frame

from corrspark.llm import suffix_dedup as sd


def brute(docs):
    seen, result = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - sd.LENGTH + 1):
            window = data[s:s + sd.LENGTH]
            if window in seen:
                gone[s:s + sd.LENGTH] = b"\1" * sd.LENGTH
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        result[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return result


def found(df, **args):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.remove_repeats(df, **args).collect()}


def crafted(seed):
    pick = random.Random(seed)
    pool = ["".join(pick.choice("ab é") for _ in range(pick.randrange(40, 400))) for _ in range(10)]
    texts = ["".join(pick.choice(pool) if pick.random() < 0.6 else "".join(pick.choice("abcdef ") for _ in range(pick.randrange(120))) for _ in range(pick.randrange(9))) for _ in range(80)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    return rows + [(1, "a" * 1000), (2, "a" * 500 + "b" + "a" * 300), (4, None), (5, ""), (7, "ab" * 300), (8, "\n" * 99), (10, texts[3]), (11, texts[3])]


@pytest.mark.parametrize("args", [{}, {"group_rows": 2}])
def test_equals_brute_force(spark, args):
    rows = crafted(len(args))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, **args) == brute(rows)


def test_many_batches_and_hand_overs(spark, monkeypatch):
    rows = crafted(7)
    want = brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_local_functions_hand_over_small_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "HELD_RUNS", 10)
    monkeypatch.setattr(sd, "PIECE", 300)
    pick = random.Random(3)
    text = "".join(pick.choice("abcd ") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 9], pa.int64()), pa.array([0, 0], pa.int32()), pa.array([text, text[500:1500]])], names=["doc", "copy", "text"])
    parts = list(sd._sample(iter([batch])))
    windows = {5: np.zeros(3000, int), 9: np.zeros(1000, int)}
    for part in parts:
        for h, _, doc, packed in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if h is not None:
                _, anchor, before, after = (int(v) for v in sd.unpack(np.int64(packed)))
                windows[doc][anchor - before:anchor - after + 1] += 1
    assert (windows[5][:2901] == 1).all() and (windows[5][2901:] == 0).all() and windows[9].max() == 1


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] is not None]
    once = list(dict.fromkeys(rows))
    result = sd.remove_repeats(frame(spark, awkward(), clashes=True)).collect()
    assert len(result) == len(awkward())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result}
    null_text = next(r[1] for r in awkward() if r[0] is None)
    want = brute([(-1, null_text), *once])
    assert got[None][:3] == want[-1][:3]
    assert all(got[i] == want[i] for i, _ in once)
    assert sd.remove_repeats(frame(spark, [])).count() == 0


def test_deep_shallow_sort_orders_and_measures():
    pick = random.Random(5)
    strings = [bytes(pick.choice(b"ab\x00") for _ in range(pick.choice([0, 3, 60, 90]))) for _ in range(200)]
    strings += [b"c" * 50 + bytes([pick.choice(b"xyz")]) * pick.randrange(30) for _ in range(100)] * 2
    group = np.array([i % 3 for i in range(len(strings))])
    for shallow in (0, 8, 40):
        order, prefix = sd.deep_shallow_sort(strings, group, shallow)
        assert sorted(order.tolist()) == list(range(len(strings)))
        for at in range(1, len(order)):
            a, b = order[at - 1], order[at]
            assert group[a] <= group[b]
            if group[a] != group[b]:
                assert prefix[at] == -1
                continue
            assert prefix[at] == sd.common_prefix(strings[a], strings[b])
            assert strings[a].rstrip(b"\0") <= strings[b].rstrip(b"\0")


def test_blind_trie_sorts():
    strings = sorted({bytes(random.Random(i).choices(b"ab", k=i % 40)) for i in range(300)})
    mixed = strings[:]
    random.Random(1).shuffle(mixed)
    trie = sd.BlindTrie(mixed)
    for k in range(len(mixed)):
        trie.add(k)
    assert [mixed[k] for k in trie.order()] == strings


def test_strings_that_all_differ_early():
    order, prefix = sd.deep_shallow_sort([b"ab", b"cd"], np.array([0, 0]))
    assert order.tolist() == [0, 1] and prefix.tolist() == [-1, 0]
    pick = random.Random(3)
    for n in (1, 2, 50):
        strings = [bytes([i]) + pick.randbytes(60) for i in range(n)]
        pick.shuffle(strings)
        order, _ = sd.deep_shallow_sort(strings, np.zeros(n, np.int64))
        assert [strings[k] for k in order] == sorted(strings)


def test_small_tables_with_one_shared_passage(spark):
    """Many tables of two texts at once: tables are kept apart by their letters."""
    pick = random.Random(17)
    rows = []
    for t in range(200):
        letters = "".join(chr(0x4E00 + 40 * t + k) for k in range(40))
        say = lambda n: "".join(pick.choice(letters) for _ in range(n))  # noqa: B023, E731
        passage = say(pick.randrange(34, 100))
        rows += [(2 * t + k, say(pick.randrange(40)) + passage + say(pick.randrange(40))) for k in range(2)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    for k in range(0, 24, 2):
        two = rows[k:k + 2]
        assert found(spark.createDataFrame(two, "doc_id long, text string").coalesce(1)) == brute(two)


def test_many_texts_without_id(spark):
    pick = random.Random(23)
    passage = "".join(pick.choice("abcdefgh") for _ in range(150))
    rows = [(None, f"{i:06d} " + passage) for i in range(4_000)] + [(5, passage + "!"), (5, "? " + passage), (5, None)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    whole = [r for r in got if r["n_removed"] == 0 and r["n_bytes"] > 0]
    assert len(got) == len(rows) and len(whole) == 1
    assert all(r["n_removed"] >= 150 and r["n_spans"] == 1 for r in got if r["n_removed"])
