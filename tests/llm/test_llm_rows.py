"""Operators 3, 5, 6 and 8: formats, shards, urls and mixtures."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import awkward, frame, prose

from corrspark.llm import chat_format, mixing, sharding, url_filter

TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "a < | b <|", None, "", "line\nbreak", "\\<|<\\", "é😀"]
    rows = [(1, t, ("user", "assistant")[t % 2], odd[t % len(odd)]) for t in range(18)]
    rows += [(2, 0, "system", "s"), (2, 1, "assistant", "first"), (2, 1, "assistant", "second"), (2, None, "user", "before")]
    rows += [(3, 0, "user", "no reply"), (4, 0, None, None), (None, 0, "assistant", "x"), (5, 0, "rôle\n<|im_end|>%0A%", "y")]
    return rows + [(6, t, ("assistant", "user")[t % 2], f"turn {t}") for t in range(400)]


def wanted(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r[2], r[3]) for r in sorted(v)] for c, v in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_read_back_is_exact(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumnRenamed("x", "y")
    turns = chat_format.format_turns(df.selectExpr("*", "'z' AS segment", "1 AS loss_start", "'q' AS _head"))
    got = {r["conv_id"]: r for r in chat_format.digest(turns).collect()}
    for conv, said in wanted(rows).items():
        replies = [t for r, t in said if r == "assistant"]
        r = got[conv]
        assert (r["n_turns"], r["n_examples"]) == (len(said), len(replies))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in said))
        assert (r["loss_chars"], r["loss_sha256"]) == (len("".join(replies)), sha("".join(replies)))
    assert len(got) == len(wanted(rows))


def test_examples_have_their_context_and_one_trainable_reply(spark):
    rows = [r for r in conversations() if r[0] in (1, 2)]
    turns = chat_format.format_turns(spark.createDataFrame(rows, TURNS))
    digests = {r["conv_id"]: r["formatted_chars"] for r in chat_format.digest(turns).collect()}
    examples = chat_format.written_out(turns).collect()
    lengths = Counter()
    for e in examples:
        lengths[e["conv_id"]] += len(e["example"])
    assert lengths == digests
    said = wanted(rows)[1]
    mine = sorted((e for e in examples if e["conv_id"] == 1), key=lambda e: e["turn"])
    for e, at in zip(mine, range(1, 18, 2), strict=True):
        assert e["example"].count("<|im_start|>") == at + 1 == e["example"].count("<|im_end|>")
        assert chat_format.unescape(e["example"][e["loss_start"]:e["loss_end"]]) == said[at][1]
        assert mine[-1]["example"].startswith(e["example"])
    only = chat_format.written_out(turns, spark.createDataFrame([(2,)], "conv_id long"))
    assert {e["conv_id"] for e in only.collect()} == {2}


def test_every_example_is_read_back(spark):
    rows = conversations()
    turns = chat_format.format_turns(spark.createDataFrame(rows, TURNS).repartition(5))
    got = {(r["conv_id"], r["example"]): r for r in chat_format.read_examples(chat_format.expand(turns)).collect()}
    want = {}
    for conv, said in wanted(rows).items():
        targets = [i for i, (role, _) in enumerate(said) if role == "assistant"]
        ends = targets + ([len(said) - 1] if targets[-1:] != [len(said) - 1] else [])
        for example, end in enumerate(ends):
            context = "".join(f"{role}\n{text}\n" for role, text in said[:end + 1])
            want[conv, example] = (end + 1, sha(context), said[end][1] if end in targets else None)
    assert {k: (r["n_turns"], r["turns_sha256"], r["reply"]) for k, r in got.items()} == want
    full = {(e["conv_id"], len(e["example"])) for e in chat_format.written_out(turns).collect()}
    assert full == {(k[0], r["chars"]) for k, r in got.items() if r["reply"] is not None}


def test_a_very_long_turn_and_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], ("<|" * 200_000 if t == 4 else f"t{t}")) for t in range(120)]
    got = chat_format.digest(chat_format.format_turns(spark.createDataFrame(rows, TURNS))).first()
    assert got["n_examples"] == 60 and got["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows))
    assert got["loss_sha256"] == sha("".join(r[3] for r in rows if r[2] == "assistant"))


def test_no_conversations(spark):
    assert chat_format.digest(chat_format.format_turns(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_even_and_match_the_mixture(spark, shards):
    rows = [(i, prose(i, 5), "en", "abc"[min(2, i % 7)], 1) for i in range(1000)]
    got = sharding.interleave(frame(spark, rows), shards).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    source = {r[0]: r[3] for r in rows}
    share = Counter(source.values())
    for s in range(shards):
        mine = Counter(source[r["doc_id"]] for r in got if r["shard"] == s)
        assert all(abs(mine[x] - share[x] / shards) <= 2 for x in share)
    text = {r[0]: r[1].encode() for r in rows}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]]), "rows", None) for r in got)
    again = sharding.interleave(frame(spark, rows, 7), shards).collect()
    assert sorted(got) == sorted(again)


def test_sharding_awkward(spark):
    got = sharding.interleave(frame(spark, awkward(), clashes=True)).collect()
    assert len(got) == len(awkward()) and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert next(r for r in got if r["doc_id"] == 1)["size"] == 8 and next(r for r in got if r["doc_id"] == 1)["text_crc32"] == 0
    assert sharding.interleave(frame(spark, [])).count() == 0
    assert {r["shard"] for r in sharding.interleave(frame(spark, awkward()[:2])).collect()} == {0, 12}


def fill(sizes, weights, share=1.5, most=2):
    """Targets by resharing until none is above its ceiling."""
    left, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = left / sum(open_.values())
        above = [s for s, w in open_.items() if level * w >= most * sizes[s]]
        if not above:
            return out | {s: level * w for s, w in open_.items()}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def seats(targets, house):
    won = dict.fromkeys(targets, 0)
    for _ in range(house):
        best = max(targets, key=lambda s: (targets[s] / (2 * won[s] + 1), [-ord(c) for c in s]))
        won[best] += 1
    return won


def mixture(seed=0):
    return [(i, prose(i, 3 + (i * 7 + seed) % 90), "en", f"s{min(i % 13, i % 5, 9)}" if i % 11 else None, 1) for i in range(600)]


def test_targets_and_seats_follow_the_definitions(spark):
    rows = mixture()
    sizes = Counter()
    for r in rows:
        sizes["n" if r[3] is None else "s" + r[3]] += len(r[1].split())
    names = sorted(sizes, key=lambda s: (s == "n", s))
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    aims = mixing.targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long"))
    got = {r["_source"]: r["target"] for r in aims.collect()}
    assert got == pytest.approx(want)
    quotas = mixing.quotas(aims, block=64, shards=7).collect()
    blocks = round(sum(got.values()) / 64)
    for k in range(1, 8):
        upto = {s: 0 for s in got} | {q["_source"]: q["first_block"] + q["n_blocks"] for q in quotas if q["shard"] == k - 1}
        assert upto == seats(got, blocks * k // 7)


def test_mix_takes_its_targets(spark):
    rows = mixture()
    got = mixing.mix(frame(spark, rows)).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] and abs(r["copies"] * r["size"] - r["taken"]) <= r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    target = {source[r["doc_id"]]: r["target"] for r in got}
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in target)
    assert sorted(got) == sorted(mixing.mix(frame(spark, rows, 9)).collect())
    copies = Counter({r["doc_id"]: r["copies"] for r in got})
    assert Counter(r["doc_id"] for r in mixing.apply(frame(spark, rows)).collect()) == +copies


@pytest.mark.parametrize("seed", [0, 3])
def test_every_shard_holds_its_quota(spark, seed):
    """Words are laid out one by one and dealt to shards by the quotas."""
    rows = mixture(seed)
    source = {r[0]: "n" if r[3] is None else "s" + r[3] for r in rows}
    size = {r[0]: len(r[1].split()) for r in rows}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    aims = mixing.targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long"))
    want = defaultdict(Counter)
    first_words = Counter()
    for s in sizes:
        order = sorted((int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16), i) for i in source if source[i] == s)
        stream = [(i, k == 0) for _, i in order for k in range(size[i])] * 2
        for q in mixing.quotas(aims).where(f"_source = '{s}'").collect():
            for i, first in stream[q["first_block"] * 64:(q["first_block"] + q["n_blocks"]) * 64]:
                want[i][q["shard"]] += 1
                first_words[i, q["shard"]] += first
    for r in mixing.mix(frame(spark, rows)).collect():
        assert r["shards"] == ",".join(f"{m}:{n}" for m, n in sorted(want[r["doc_id"]].items())), r
        assert r["taken"] == want[r["doc_id"]].total()
    out = mixing.apply(frame(spark, rows), shard="part")
    assert Counter((r["doc_id"], r["part"]) for r in out.collect()) == +first_words


def test_mixing_awkward(spark):
    docs = frame(spark, awkward(), clashes=True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    out = mixing.apply(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.apply(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None, None, 0)])).first()["target"] == 0


PAGES = "page_id long, url string, html string"


def test_rules_and_parts(spark):
    urls = {
        "http://A.Org/x?y": ("a.org", "/x", "org/", "allow"),
        "https://example.org/es/1#t": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, None),
        "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
        "ftp://x.com/fr/?u=http://y.org/": ("x.com", "/fr/", "com/fr/", "allow"),
        "x.com?u=http://y.com/de/a": ("y.com", "/de/a", "com/de/", "block"),
        "x.com/de/a": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(99, None, "<a href='http://z.net/'>"), (0, "http://A.Org/x?y", None)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'a' AS host", "'b' AS rule", "'c' AS found")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    for i, (_, want) in enumerate(urls.items()):
        assert got[i][:3] == want[:3] and want[3] in (None, got[i][3])
    assert got[99] == ("", "", None, "allow") and url_filter.filter_urls(df).count() == len(rows)
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_distrust_goes_against_links_and_trust_along(spark):
    link = '<a class=x href="{}">a</a>'
    rows = [
        (1, "http://good.com/fr/1", link.format("http://friend.net/a") * 5),
        (2, "http://bad.com/de/1", ""),
        (3, "http://farm.biz/x", link.format("//bad.com/de/1") * 5 + link.format("mailto:a@b")),
        (4, "http://friend.net/a", link.format("/b")),
        (5, "http://lonely.info/x", ""),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    edges = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(url_filter.judged_pages(spark.createDataFrame(rows, PAGES))).collect()}
    assert edges["good.com", "friend.net"] == 5 and edges["farm.biz", "bad.com"] == 5 and edges["friend.net", "friend.net"] == 1
    assert edges["friend.net", "net"] == edges["net", "friend.net"] == 1


def test_distrust_reaches_the_end_of_a_chain(spark):
    hosts = [f"h{i:02d}" for i in range(15)]
    rows = [(i, f"http://{h}/x", f'<a href="http://{hosts[i + 1] if i < 14 else "bad.com"}/">') for i, h in enumerate(hosts)]
    rows += [(90, "http://bad.com/de/1", ""), (91, "http://good.com/fr/1", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**{i: "block" for i in range(15)}, 90: "block", 91: "allow"}


def test_ranks_solve_their_equation(spark):
    edges = [("a", "a", 7), ("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("b", "b", 1), ("d", "e", 5), ("e", "d", 5)]
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("e", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight long"), seeds).collect()}
    for kind, ways, seed in (("trust", edges, "a"), ("distrust", [(b, a, w) for a, b, w in edges], "e")):
        out = {h: sum(w for a, _, w in ways if a == h) for h in got}
        for h in got:
            want = 0.15 * (h == seed) + sum(0.85 * w / out[a] * got[a][kind] for a, b, w in ways if b == h)
            assert abs(got[h][kind] - want) < 1e-8


def brute_interleave(rows, shards, seed="interleave-1"):
    """Fractional ranks of the seeded order of each source, sorted and cut."""
    import hashlib
    import zlib

    facts = []
    for i, text, source in rows:
        data = (text or "").encode()
        draw = int(hashlib.md5(f"{seed}:{'-' if i is None else i}".encode()).hexdigest()[:15], 16)
        facts.append(("n" if source is None else "s" + source, (draw, i is not None, i or 0, zlib.crc32(data), len(data) + 8), i))
    by_source = {}
    for f in facts:
        by_source.setdefault(f[0], []).append(f)
    order = []
    for source, own in by_source.items():
        own.sort(key=lambda f: f[1])
        order += [((2 * k + 1) / (2 * len(own)), source, f[1], f[2]) for k, f in enumerate(own)]
    order.sort(key=lambda f: f[:3])
    n = len(order)
    out = []
    for place, (_, _, (_, _, _, crc, size), i) in enumerate(order):
        shard = place * shards // n
        out.append((i, size, crc, "rows", shard, place - -(-shard * n // shards), None))
    return out


def test_interleaving_equals_brute_force(spark):
    from corrspark.llm import sharding

    mixed = [(i, "x" * (i % 50), "en", f"s{i % 3 * (i % 2)}", 1) for i in range(700)]
    for rows in (awkward(), awkward()[:5], mixed):
        got = sharding.interleave(frame(spark, rows)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:6])
        assert sorted(map(tuple, got), key=key) == sorted(brute_interleave([(r[0], r[1], r[3]) for r in rows], 24), key=key)
