"""Upserts, control table, sinks, lookups, requests, streams."""

import random
import re

import cpe_plain
import pytest
from pyspark.sql import functions as F

from corrspark.operators import control, cpe, grams, links, sample, tasks, upsert
from corrspark.plans import refresh
from corrspark.sources import buckets, writers
from corrspark.streaming import jobs


def test_last_per_key_with_a_hot_key(spark, rows):
    data = [("hot" if i % 3 else f"k{i}", i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(data, "k string, o int, v string").repartition(7)
    want = {}
    for k, o, v in data:
        want[k] = (o, v)
    assert {r["k"]: (r["o"], r["v"]) for r in upsert.last_per_key(df, ["k"], ["o"]).collect()} == want


def test_upsert_is_idempotent(spark, rows):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, o int")
    once = upsert.upsert(old, new, ["id"], ["o"])
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(upsert.upsert(once, new, ["id"], ["o"])) == rows(once)


def test_number_steps_across_chunks(spark, rows):
    steps = spark.createDataFrame([("p", str(i % 2), i) for i in range(9)], "capec_id string, step string, pos int")
    whole = rows(links.number_steps(steps), "pos", "step")
    assert whole == rows(links.number_steps(steps, chunk=2), "pos", "step")
    assert [s for _, s in whole] == ["0", "1", "0b", "1b", "0c", "1c", "0d", "1d", "0e"]


def test_control(spark):
    old = spark.createDataFrame([("CVE", None, None, False, 7, "1", "Pending")], "name string, last_update timestamp, next_scheduled_update timestamp, has_been_updated boolean, update_frequency int, version string, status string")
    done = spark.sql("select 'CVE' name, cast(null as string) version, timestamp'2024-01-01' last_update union all select 'CWE', '4', timestamp'2024-01-02'")
    got = {r["name"]: r for r in control.record_refresh(old, done).collect()}
    assert str(got["CVE"]["next_scheduled_update"]) == "2024-01-08 00:00:00" and got["CVE"]["version"] == "1"
    assert got["CWE"]["next_scheduled_update"] is None and got["CWE"]["has_been_updated"] and got["CWE"]["status"] == "Pending"
    assert tuple(control.refresh_state(old).first()) == (True, True, False)
    assert control.refresh_state(old.limit(0)).first()["needs_update"]
    assert control.on_failure(control.on_publish(old)).first()["status"] == "Pending"
    assert control.rebuild_targets("CAPEC")[-1] == "preprocessed_attack_step"
    with pytest.raises(ValueError):
        control.rebuild_targets("X")
    with pytest.raises(ValueError, match="missing"):
        refresh.rebuild("CVE", {}, "nowhere")


def test_snapshots(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    assert writers.read_snapshot(spark, root) is None
    assert writers.read_snapshot(spark, root, "a int").count() == 0
    writers.write_snapshot(spark.range(3), root)
    current = writers.read_snapshot(spark, root)
    writers.write_snapshot(current.filter("id > 0"), root)  # reads the version it replaces
    assert rows(writers.read_snapshot(spark, root)) == [(1,), (2,)]


def test_statistics_are_served_until_refreshed(spark, tmp_path):
    control_rows = spark.sql("select 'CVE' name, timestamp'2000-01-01' last_update")
    calls = []

    def build():
        calls.append(1)
        return spark.range(2)

    path = str(tmp_path)
    for _ in range(2):
        assert writers.statistics(spark, path, "n", control_rows, "CVE", build).count() == 2
    assert len(calls) == 1
    later = spark.sql("select 'CVE' name, timestamp'2999-01-01' last_update")
    writers.statistics(spark, path, "n", later, "CVE", build)
    assert len(calls) == 2


def test_search_and_lookups(spark, rows):
    df = spark.createDataFrame([("CVE-1", "x" * 120), ("CVE-12", "short"), ("CVE-2", "y")], "id string, description string")
    assert rows(links.search(df, "id", "CVE-1"), "id") == [("CVE-1",)]
    assert rows(links.search(df, "id", "CVE-"), "id") == [("CVE-1",), ("CVE-12",), ("CVE-2",)]
    assert rows(links.search(df, "id", "zzz")) == []
    assert [r["id"] for r in links.suggestions(df, "id", "cve-1").collect()] == ["CVE-1", "CVE-12"]
    assert links.suggestions(df, "id", "cve-1").first()["detail"] == "x" * 100 + "..."
    assert rows(links.browse(df, "SHORT", ("id", "description")), "id") == [("CVE-12",)]


def test_completeness_keeps_its_parts(spark):
    asked = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2), ("t", None), ("u", 3)], "task_id string, cve_id int")
    done = spark.createDataFrame([("t", 1, "complete"), ("t", None, "complete"), ("t", 2, "failed"), ("u", 3, "complete"), ("u", 4, "complete")], "task_id string, cve_id int, status string")
    state = tasks.completeness(asked, done)
    assert sorted(tuple(r) for r in state.collect()) == [("t", 3, 2, 0, False), ("u", 1, 2, 1, False)]
    # parts of a given number are not merged by their packed bytes
    assert "REPARTITION_BY_NUM" in state._jdf.queryExecution().executedPlan().toString()


def test_requests(spark, rows):
    asked = spark.createDataFrame([("t", "a", "h2"), ("t", "a", "h1"), ("t", "b", "h2")], "task_id string, cve_id string, host string")
    assert rows(tasks.invert_hosts(asked), "cve_id", "host", "n_hosts") == [("a", "h1", 2), ("a", "h2", 2), ("b", "h2", 1)]
    assert rows(tasks.hosts_of(asked, "a")) == [("h1",), ("h2",)]
    assert rows(tasks.graph_selection(asked)) == [("h1", "a"), ("h2", "b")]
    done = spark.createDataFrame([("t", "a", "complete"), ("t", "z", "complete")], "task_id string, cve_id string, status string")
    row = tasks.completeness(asked, done).first()
    assert (row["requested"], row["complete"], row["foreign"], row["is_complete"]) == (2, 2, 1, False)


def test_samples_do_not_depend_on_partitions(spark, rows):
    df = spark.range(500).withColumn("t", F.make_timestamp_ntz(F.lit(2000) + F.col("id") % 5, *[F.lit(1)] * 2, *[F.lit(0)] * 3))
    one = rows(sample.per_year(df.coalesce(1), "id", "t", 7, 2001, 2003, 5), "id")
    many = rows(sample.per_year(df.repartition(9), "id", "t", 7, 2001, 2003, 5), "id")
    assert one == many and len(one) == 21
    assert rows(sample.uniform(df.repartition(9), "id", 10, 1), "id") == rows(sample.uniform(df.coalesce(1), "id", 10, 1), "id")
    assert rows(sample.uniform(df, "id", 10, 1), "id") != rows(sample.uniform(df, "id", 10, 2), "id")


def test_stream_equals_batch(spark, tmp_path, rows):
    draw = random.Random(4)
    data = [(draw.randint(0, 9), i, f"v{i}") for i in range(200)]
    draw.shuffle(data)  # late rows must not win
    source = str(tmp_path / "in")
    for part in range(4):
        spark.createDataFrame(data[part * 50 : part * 50 + 50], "k int, o int, v string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k int, o int, v string").option("maxFilesPerTrigger", 1).parquet(source)
    root, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    keys, order = ["k"], ["o"]
    jobs.upsert_stream(stream, root, keys, order, mark).awaitTermination()
    want = rows(upsert.last_per_key(spark.read.parquet(source), keys, order))
    assert rows(jobs.current(spark, root, keys, order)) == want
    # a second run finds nothing new, and a replay of all rows changes nothing
    jobs.upsert_stream(stream, root, keys, order, mark).awaitTermination()
    jobs.upsert_stream(stream, root, keys, order, str(tmp_path / "again")).awaitTermination()
    assert rows(jobs.current(spark, root, keys, order)) == want
    # compacted, the table goes on from its snapshot
    fresh = str(tmp_path / "compacted")
    jobs.compact_into(spark, root, fresh, keys, order)
    assert rows(jobs.current(spark, fresh, keys, order)) == want
    spark.createDataFrame([(3, 999, "new"), (4, -1, "late")], "k int, o int, v string").write.mode("append").parquet(source)
    jobs.upsert_stream(stream, fresh, keys, order, mark).awaitTermination()
    assert rows(jobs.current(spark, fresh, keys, order)) == sorted([r for r in want if r[0] != 3] + [(3, 999, "new")])


def test_request_stream_answers_once(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "task_id string, cve_id string").write.mode("append").parquet(source)
    stream = spark.readStream.schema("task_id string, cve_id string").option("maxFilesPerTrigger", 1).parquet(source)
    jobs.request_stream(stream, lambda b: b.withColumn("answer", F.upper("cve_id")), out).awaitTermination()
    want = [("t", "a", "A"), ("t", "b", "B"), ("u", "a", "A")]
    assert rows(jobs.answers(spark, out), "task_id", "cve_id", "answer") == want
    spark.createDataFrame([("u", "b")], "task_id string, cve_id string").write.mode("append").parquet(source)
    jobs.request_stream(stream, lambda b: b.withColumn("answer", F.lower("cve_id")), out).awaitTermination()  # a new run on the same path
    assert rows(jobs.answers(spark, out), "task_id", "cve_id", "answer") == [*want, ("u", "b", "b")]


def test_upsert_keeps_columns_of_both_sides(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, kept int")
    new = spark.createDataFrame([(2, "c", True, 1)], "id int, x string, extra boolean, o int")
    got = {r["id"]: (r["x"], r["kept"], r["extra"]) for r in upsert.upsert(old, new, ["id"], ["o"]).collect()}
    assert got == {1: ("a", 5, None), 2: ("c", None, True)}


def test_steps_without_position_or_pattern_stay(spark):
    from corrspark.operators import links

    rows = [("p", "1", 0), ("p", "1", None), (None, "1", 3), (None, "1", 4)]
    got = links.number_steps(spark.createDataFrame(rows, "capec_id string, step string, pos long")).collect()
    assert len(got) == 4 and sorted(r["step"] for r in got) == ["1", "1", "1b", "1b"]


def test_rank_matrix_keeps_unranked_patterns(spark):
    from corrspark.operators import tasks

    ranked = spark.createDataFrame([("c1", "m", "P-1", 1), ("c2", "m", "P-2", 1)], "cve_id string, model string, capec_id string, rank int")
    patterns = spark.createDataFrame([("P-1", "one", "Draft"), ("P-2", "two", None), ("P-3", "three", "Draft"), ("P-4", "gone", "Deprecated")], "id string, name string, status string")
    got = {(r["cve_id"], r["capec_id"]): r["m_rank"] for r in tasks.rank_matrix(ranked, patterns, ["m"]).collect()}
    assert got == {(c, p): {("c1", "P-1"): 1, ("c2", "P-2"): 1}.get((c, p)) for c in ("c1", "c2") for p in ("P-1", "P-2", "P-3")}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from corrspark.session import scratch_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")
    assert scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]")), "x")


# --- platform names --------------------------------------------------------

def test_bucket_merge_rewrites_touched_buckets_only(spark, rows, tmp_path):
    root, keys, order = str(tmp_path / "table"), ["k"], ["at"]
    pick = random.Random(2)
    want, schema = {}, "k int, at int, v string, deleted boolean"
    changed = []
    for round_ in range(6):
        batch = [(pick.randrange(200), 10 * round_ + pick.randrange(15), f"v{round_}", pick.random() < 0.2) for _ in range(150 if round_ == 0 else 5)]
        batch = list({(k, at): (k, at, v, d) for k, at, v, d in batch}.values())
        batch = [b for b in batch if all(b[1] != t for t, *_ in [want.get(b[0], (-1,))])]
        before = buckets.manifest(spark, root)
        touched = buckets.merge(spark.createDataFrame(batch, schema), root, keys, order, 16)
        for k, at, v, d in sorted(batch, key=lambda b: b[1]):
            if k not in want or want[k][0] < at:
                want[k] = (at, v, d)
        assert rows(buckets.read(spark, root), "k", "at", "v") == sorted((k, at, v) for k, (at, v, d) in want.items() if not d)
        after = buckets.manifest(spark, root)
        if before:
            changed.append({b for b in after.parts if after.parts[b] != before.parts.get(b)})
            assert changed[-1] == {str(b) for b in touched} and len(touched) <= 5
    assert any(c for c in changed)
    # an earlier row does not bring a deleted key back; dropped tombstones are gone for good
    doomed = spark.createDataFrame([(k, 10_000) for k in range(100)], "k int, at int")
    buckets.delete(doomed, root, keys, order)
    buckets.merge(spark.createDataFrame([(5, 9_999, "late")], "k int, at int, v string"), root, keys, order)
    assert all(r["k"] >= 100 for r in buckets.read(spark, root).collect())
    buckets.merge(spark.createDataFrame([(5, 10_001, "later", "new")], "k int, at int, v string, w string"), root, keys, order, drop=True)
    assert [tuple(r) for r in buckets.read(spark, root).filter("k < 100").select("k", "v", "w").collect()] == [(5, "later", "new")]
    with pytest.raises(ValueError, match="keyed"):
        buckets.merge(doomed, root, ["at"], ["k"])
    assert buckets.merge(doomed.limit(0), root, keys, order) == [] and buckets.read(spark, str(tmp_path / "none")) is None


def test_a_log_is_folded_in_place(spark, rows, tmp_path):
    src, root, keys, order = tmp_path / "src", str(tmp_path / "t"), ["k"], ["at"]
    put = lambda name, data: spark.createDataFrame(data, "k int, at int, v string, deleted boolean").coalesce(1).write.mode("append").parquet(str(src / name))
    mark = str(tmp_path / "mark")

    def run():
        stream = spark.readStream.schema("k int, at int, v string, deleted boolean").parquet(str(src) + "/*")
        jobs.upsert_stream(stream, root, keys, order, mark).awaitTermination()

    now = lambda: rows(jobs.current(spark, root, keys, order), "k", "at", "v")
    put("a", [(1, 1, "x", False), (2, 1, "y", False), (3, 1, "z", None)])
    run()
    assert now() == [(1, 1, "x"), (2, 1, "y"), (3, 1, "z")]
    jobs.compact(spark, root, keys, order, 4)
    assert now() == rows(buckets.read(spark, root), "k", "at", "v") == [(1, 1, "x"), (2, 1, "y"), (3, 1, "z")]
    assert jobs.compact(spark, root, keys, order) == []  # all batches are in
    put("b", [(2, 2, None, True), (4, 2, "new", False), (1, 0, "late", False)])
    run()
    assert now() == [(1, 1, "x"), (3, 1, "z"), (4, 2, "new")]
    parts = buckets.manifest(spark, root).parts
    touched = jobs.compact(spark, root, keys, order)
    assert now() == [(1, 1, "x"), (3, 1, "z"), (4, 2, "new")]
    assert {b for b, p in buckets.manifest(spark, root).parts.items() if p != parts.get(b)} <= {str(b) for b in touched}


def test_a_batch_reads_its_own_buckets_of_answered_requests(spark, tmp_path):
    data = spark.range(500).select(F.lit("t").alias("task_id"), F.col("id").cast("string").alias("cve_id"))
    data.write.parquet(str(tmp_path / "src"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "src"))
    jobs.request_stream(stream, lambda b: b, out).awaitTermination()
    asked = data.limit(1).withColumn("bucket", buckets.bucket_of(["task_id", "cve_id"], jobs.REQUEST_BUCKETS))
    found = jobs.answered_requests(spark, out, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < found.count() < 60


def test_indexed_search_is_a_scan(spark, tmp_path):
    pick = random.Random(14)
    texts = ["".join(pick.choice("abÉé ") for _ in range(pick.randrange(0, 30))) for _ in range(120)] + [None, "", "ab"]
    df = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "id int, t string, s string")
    path = grams.build(df, "id", ("t", "s"), str(tmp_path / "grams"))
    for query in ["ab", "aba", "ba é", "éÉa", "b" * 9, "zzz", "s3", "S1"]:
        want = sorted(i for i, t in enumerate(texts) if query.lower() in (t or "").lower() or query.lower() in f"s{i % 7}")
        assert sorted(r["id"] for r in grams.search(df, "id", ("t", "s"), query, path).collect()) == want, query
    plan = grams.postings(spark, path, "aba")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "PartitionFilters: [" in plan and "bucket" in plan
    assert "PushedFilters: [" in plan and "piece" in plan.split("PushedFilters")[1]
    assert grams.postings(spark, path, "ab") is None


def test_index_holds_lists_of_keys(spark, tmp_path):
    data = [(i // 2, "ab\U0001f600cd" if i % 2 else "abé") for i in range(400)] + [(None, "abé"), (7, "cdabé")]
    df = spark.createDataFrame(data, "id long, t string").coalesce(1)
    path = grams.build(df, "id", ("t",), str(tmp_path / "grams"))
    # a piece has a list per run of texts, not a row per text
    assert spark.read.parquet(f"{path}/postings").count() == 3 + 3
    found = lambda query: sorted(r["id"] for r in grams.search(df, "id", ("t",), query, path).collect())
    assert found("B\U0001f600C") == list(range(200)) and found("dabÉ") == [7] and found("abé") == sorted([*range(200), 7])


def test_pieces_of_many_letters_are_taken_in_halves():
    import pyarrow as pa

    texts = ["".join(map(chr, range(300 + 7 * i, 300 + 7 * i + 40))) for i in range(9)] + ["", "ab"]
    def holders(columns):
        out = {}
        for names, ends, rows in grams._holders(columns):
            for name, a, b in zip(names, ends, ends[1:]):
                out.setdefault(name, set()).update(rows[a:b].tolist())
        return out

    want = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 2):
            want.setdefault(t[k:k + 3], set()).add(i)
    assert holders([pa.array(texts)]) == want
    assert holders([pa.array(texts), pa.array(["abc"] * len(texts))]) == want | {"abc": set(range(len(texts)))}
    # every letter of the code, so that pieces and rows pass one number
    wide = pa.array(["".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)])), "abc", "xabc", "abc", "", "abc", "abc", "abc", "abc"])
    assert holders([wide])["abc"] == {0, 1, 2, 3, 5, 6, 7, 8}


URI = "cpe:2.3:a:apache:http_server:1.3:*:*:en:pro:linux:*:*"


def test_cpe_parse(spark):
    df = spark.createDataFrame([(URI,), ("cpe:2.3:a:b:c",), (r"cpe:2.3:a:b\:x:c:1:*:*:*:*:*:*:*",)], "uri string")
    got = {r["uri"]: r for r in cpe.parse_uris(df, "uri").collect()}
    assert len(got) == 2 and tuple(got[URI])[1:] == ("a", "apache", "http_server", "1.3", "*", "*", "pro", "en", "linux")
    escaped = {r["uri"]: r for r in cpe.parse_uris(df, "uri", escaped=True).collect()}
    assert escaped[r"cpe:2.3:a:b\:x:c:1:*:*:*:*:*:*:*"]["vendor"] == r"b\:x"


def test_cpe_columns_agree_with_the_word_helpers(spark):
    texts = ["The Apache Http  Server and apache big http server, Apache x y http server", "a.b c a.b", "", None, "h ttp ser ver http server h t t p", "été ÉTÉ \\E x"]
    terms = [("apache", "http server"), ("", "http server pro"), ("apache soft", "x"), ("", "one"), ("été", "\\E x")]
    rows = [(i, j, t, v, p) for i, t in enumerate(texts) for j, (v, p) in enumerate(terms)]
    df = spark.createDataFrame(rows, "i int, j int, t string, v string, p string")
    got = df.select("t", "v", "p", cpe.exact_matches(F.col("t"), F.col("p")).alias("exact"), cpe.partial_matches(F.col("t"), F.col("v"), F.col("p")).alias("near"),
                    cpe.replace_split_word(F.col("t"), F.split_part("p", F.lit(" "), F.lit(1)), "#").alias("split")).collect()
    for r in got:
        if r["t"] is None:
            assert r["exact"] is None and r["split"] is None
            continue
        assert [tuple(m) for m in r["exact"]] == cpe_plain.spans(cpe_plain.exact_pattern(r["p"]), r["t"].lower())
        assert [tuple(m) for m in r["near"]] == [m for p in cpe_plain.partial_patterns(r["v"], r["p"]) for m in cpe_plain.spans(p, r["t"])]
        assert r["split"] == cpe_plain.replace_split(r["t"], r["p"].split()[0], "#")


def test_short_words_are_left_out_without_a_division(spark):
    df = spark.createDataFrame([(a * "x", b * "x") for a in range(12) for b in range(12)], "a string, b string")
    for threshold in (50, 70, 71, 80, 99):
        close, same = cpe.is_close(F.col("a"), F.col("b"), threshold), cpe.ratio(F.col("a"), F.col("b")) > threshold
        assert df.filter((F.length("a") + F.length("b") > 0) & (close != same)).count() == 0
        assert "/" not in str(close).split(" THEN ")[0]


def _random_text(pick, words, n):
    return "".join(pick.choice(words) + pick.choice([" ", " ", " ", "  ", ", ", ".", "-"]) for _ in range(n))


NAMES = "apache apachee appache http server servre servers web kit webkit linux 1.3 win application hardware operating system née x ab a-b pro".split()


def test_fuzzy_runs_stand_for_all_matching_runs():
    pick = random.Random(4)
    for _ in range(120):
        text = _random_text(pick, NAMES, pick.randrange(0, 9))
        term = " ".join(pick.choice(NAMES) for _ in range(pick.randrange(1, 4)))
        want = {(p, n) for _, p, n in cpe_plain.fuzzy_spans(term, text, extra_words=None)}
        ends = [m.end() for m in re.finditer(r"\w+", text)]
        got, rows = set(), cpe.fuzzy_runs(term, text)
        for run, position, length, open_ in rows:
            assert text[position:position + length] == run
            got |= {(position, e - position) for e in ends if e - position == length or (open_ and e - position > length)}
        assert got == want
        assert sum(r[3] for r in rows) <= len(ends)
    assert cpe.fuzzy_runs("x" * 70, "a " + "x" * 70 + " b") == [("a " + "x" * 70, 0, 72, True), ("x" * 70, 2, 70, True)]
    assert cpe.fuzzy_runs("", "a b") == [] and cpe.fuzzy_runs("a", "") == []


def test_fuzzy_span_column(spark):
    df = spark.createDataFrame([("http servers run", "http server"), (None, "a"), ("a", None)], "t string, w string")
    got = [r["m"] for r in df.select(cpe.fuzzy_span_matches(F.col("t"), F.col("w")).alias("m")).collect()]
    assert got[1] is None and got[2] is None
    assert [tuple(m) for m in got[0]] == cpe.fuzzy_runs("http server", "http servers run")


def test_close_words_equal_the_plain_ratio(spark):
    from corrspark.functions.words import ratio

    pick = random.Random(9)
    words = ["".join(pick.choice("abcd") for _ in range(pick.randrange(1, 14))) for _ in range(160)] + ["x" * 80 + "y" * 9, "x" * 75 + "z" * 9, "é" * 5, "éé"]
    pairs = [(a, b) for a in words[-40:] for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", cpe.ratio(a, b).alias("r"), *(cpe.is_close(a, b, t).alias(f"c{t}") for t in (50, 69, 70, 80))).collect():
        assert r["r"] == ratio(r["a"], r["b"])
        assert all(r[f"c{t}"] == (r["r"] > t) for t in (50, 69, 70, 80))


def test_fuzzy_matches_equal_the_plain_words(spark):
    pick = random.Random(12)
    rows = [(_random_text(pick, NAMES, 30), pick.choice(NAMES)) for _ in range(60)] + [("", "a"), ("née NÉE", "née")]
    df = spark.createDataFrame(rows, "t string, w string")
    for r in df.select("t", "w", cpe.fuzzy_matches(F.col("t"), F.col("w")).alias("m")).collect():
        assert [tuple(m) for m in r["m"]] == cpe_plain.fuzzy_words(r["w"], r["t"])


def test_fuzzy_matches_of_many_terms_in_pieces(spark, monkeypatch):
    """A list of terms finds what they find one by one, whatever the pieces of a batch; places are those of the text as it stands."""
    rows = [("Der Server, servre İİ Server", ["server", "İİ", None, "der"]), (None, ["a"]), ("", ["a"]), ("  x server", []), ("servers", None), ("lone server", ["SERVER"])]
    df = spark.createDataFrame(rows, "t string, ws array<string>").repartition(1)
    got = {r["t"]: r["m"] for r in df.select("t", cpe.fuzzy_matches_each(F.col("t"), F.col("ws")).alias("m")).collect()}
    one = df.select("t", F.explode("ws").alias("w")).select("t", "w", cpe.fuzzy_matches(F.col("t"), F.col("w")).alias("m")).collect()
    for t, ws in rows:
        if t is None or ws is None:
            assert got[t] is None
            continue
        want = [(r["w"], *m) for r in one if r["t"] == t for m in r["m"]]
        assert sorted(map(tuple, got[t])) == sorted(want)
        assert all(t[m["position"]:m["position"] + m["length"]] == m["matched"] for m in got[t])
    assert [m["position"] for m in got["Der Server, servre İİ Server"] if m["term"] == "server"] == [4, 12, 22]


def test_pieces_of_a_batch_are_bounded():
    import pyarrow as pa

    from corrspark.functions.pieces import pieces

    texts = pa.array(["a" * 10, None, "b" * 500, "", "c"])
    assert list(pieces(texts, 100)) == [(0, 2), (2, 1), (3, 2)]
    assert list(pieces(pa.array([["a"] * 30, None, [], ["b"]]), 80)) == [(0, 3), (3, 1)]
    assert list(pieces(pa.array([], pa.string()))) == []


def test_cpe_aggregate(spark):
    data = [(1, "cpe:2.3:a:v:p:2:*:*:*:*:win:*:*"), (2, "cpe:2.3:a:v:p:1:-:*:*:*:win:*:*"), (3, "cpe:2.3:a:v:p:2:*:*:*:*:mac"), (4, "cpe:/a:v:p"), (5, "cpe:2.3:a:v")]
    row = cpe.aggregate_uris(spark.createDataFrame(data, "i int, uri string"), "uri", pos="i").collect()
    assert len(row) == 1 and (row[0]["versions"], row[0]["updates"], row[0]["target_sws"]) == (["2", "1"], [], ["win", "mac"])


def test_cpe_aggregate_equals_the_plain_lists(spark):
    """Every list of every product, by request, from URIs that lack fields, repeat or are none."""
    pick = random.Random(16)
    data = []
    for i in range(400):
        fields = [pick.choice(["*", "-", "", "1", "2", "é"]) for _ in range(pick.randrange(0, 10))]
        head = pick.choice(["cpe:2.3:"] * 6 + ["cpe:2.3", "cpe:/", "xcpe:2.3:", "cpe:2.30:"]) + f"{pick.choice('ah')}:{pick.choice(['v', ''])}:{pick.choice('pq')}"
        data.append((pick.choice(["x", "y", None]), i, pick.choice([":".join([head, *fields])] * 9 + [None])))
    data += [("x", 400, "cpe:2.3:o:v:bare:*:-:*:*:*"), ("x", 401, "cpe:2.3:o:v:bare:*:-:*:*:*:*:*:*")]
    df = spark.createDataFrame(data, "k string, i int, uri string").repartition(5)
    got = {(r["k"], r["part"], r["vendor"], r["product"]): {f: list(r[f"{f}s"]) for f in cpe.DETAIL_FIELDS} for r in cpe.aggregate_uris(df, "uri", ("k",), "i").collect()}
    want = {}
    for key in ("x", "y", None):
        for name, lists in cpe_plain._blocks([u for k, _, u in data if k == key and u]).items():
            want[key, *name] = lists
    assert got == want and got["x", "o", "v", "bare"] == {f: [] for f in cpe.DETAIL_FIELDS}
    one = {(r["part"], r["product"]): r["versions"] for r in cpe.aggregate_uris(df, "uri").collect()}
    assert all(v == sorted(v) for v in one.values())  # without positions, by value


def test_cpe_aggregate_makes_the_uri_once(spark, tmp_path):
    """A URI made by an expression is not made again for each test of it, and products are gathered by a hash of their names."""
    spark.createDataFrame([("a:v:p:2:*:*:*:*:win:*:*",)], "rest string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select(F.concat(F.lit("cpe:2.3:"), F.upper("rest")).alias("uri"))
    out = cpe.aggregate_uris(df, "uri")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("upper(") == 1 and "xxhash64(" in plan
    assert [(r["vendor"], r["versions"], r["target_sws"]) for r in out.collect()] == [("V", ["2"], ["WIN"])]


def test_cpe_matching():
    text = "the apache http server and apache big http server"
    assert [m[0] for p in cpe_plain.partial_patterns("apache", "http server") for m in cpe_plain.spans(p, text)] == [
        "apache http server", "apache http server", "apache big http server"]
    assert [m[0] for p in cpe_plain.partial_patterns("", "http server pro") for m in cpe_plain.spans(p, text)] == ["http server", "http server"]
    assert cpe_plain.fuzzy_words("apache", "an apachee server") == [("apachee", 3, 7)]
    assert cpe_plain.replace_split("web ki t or we b kit or webkit", "webkit", "X") == "X or X or webkit"
    assert ("http servers", 0, 12) in cpe_plain.fuzzy_spans("http server", "http servers run")


def test_cpe_masking():
    text = "mod_usertrack in Apache HTTP Server 1.3 for linux by apache lets http server users in"
    assert cpe_plain.mask_text(text, [URI]) == "mod_usertrack in application for software by application users in"
    assert cpe_plain.mask_text(text, ["broken"]) == text


def test_mask_column(spark):
    df = spark.createDataFrame([("Apache HTTP Server x", [URI]), ("same", None), (None, [URI])], "t string, u array<string>")
    got = [r["m"] for r in df.select(cpe.mask_products(F.col("t"), F.col("u")).alias("m")).collect()]
    assert got == ["application x", "same", None]


def test_masks_equal_the_plain_rules(spark):
    pick = random.Random(31)
    products = ["http_server", "webkit", "pro", "a-b", "apache", "linux_kit_pro", "$1", "née"]
    rows = []
    for _ in range(150):
        uris = [f"cpe:2.3:{pick.choice('ahox')}:{pick.choice(['apache', 'web_kit', 'née', ''])}:{pick.choice(products)}:{pick.choice(['1.3', '*', '-', 'pro'])}:*:*:en:*:{pick.choice(['linux', '*'])}"
                + pick.choice(["", ":*:*"]) for _ in range(pick.randrange(0, 4))]
        rows.append((_random_text(pick, [*NAMES, "h ttp", "web k it", "a pache", "Apache HTTP Server", "$1"], pick.randrange(0, 14)), uris + pick.choice([[], ["broken"]])))
    df = spark.createDataFrame(rows, "t string, u array<string>")
    for r in df.select("t", "u", cpe.mask_products(F.col("t"), F.col("u")).alias("m")).collect():
        assert r["m"] == (cpe_plain.mask_text(r["t"], list(r["u"])) if r["u"] else r["t"]), (r["t"], r["u"])


def test_masks_of_plain_and_other_texts_are_alike(spark):
    """Plain texts are asked for words before patterns are made, others are searched: letters outside ASCII, capitals of a label, other blanks change nothing."""
    texts = ["apache http server 1.3 web", "apache\thttp\tserver on web kit", "the serverſ runs http", "apachee web big kit, x", "x y z", "kit web x", "a  b . c", "http apache linux kit"]
    uris = [f"cpe:2.3:{part}:{vendor}:{product}:1.3:*:*:en:*:linux" for part in ("a", "X", "née", "$1") for vendor in ("apache", "big_web", "x")
            for product in ("http_server", "x_y", "web_kit_pro", "kit", "http__server")]
    rows = [(t + end, [u, *more]) for t in texts for u in uris for end in ("", " é") for more in ([], [uris[7], u.replace("1.3", "2")])]
    df = spark.createDataFrame(rows, "t string, u array<string>")
    for r in df.select("t", "u", cpe.mask_products(F.col("t"), F.col("u")).alias("m")).collect():
        assert r["m"] == cpe_plain.mask_text(r["t"], list(r["u"])), (r["t"], r["u"])


def test_masks_make_no_patterns_of_words_that_are_not_there(spark):
    """A product of many words, none of them in the text, costs a search for each word, not a pattern for each word left out."""
    import time

    def seconds(words: int) -> float:
        uri = "cpe:2.3:a:v:" + "_".join(f"w{i}q" for i in range(words)) + ":*:*:*:*:*:*"
        df = spark.range(40, numPartitions=1).select(F.concat(F.lit("some plain text "), F.col("id").cast("string")).alias("t"), F.array(F.lit(uri)).alias("u"))
        masked = df.select(cpe.mask_products(F.col("t"), F.col("u")).alias("m"))
        start = time.time()
        assert masked.filter(F.col("m") == F.concat(F.lit("some plain text "), F.lit("0"))).count() == 1
        return time.time() - start

    seconds(2)  # the first run makes the session ready
    assert seconds(1000) < 5 * seconds(2) + 5


def test_fuzzy_terms_brute_force(spark):
    from corrspark.functions.words import ratio

    words = "apache apachee server servre widget gadget gadgets bolt".split()
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "apache bolt")], "id int, t string")
    terms = spark.createDataFrame([("apache",), ("server",), ("gadget",)], "term string")
    want = {(t, w, ratio(w, t)) for t in ("apache", "server", "gadget") for w in words if ratio(w, t) > 70}
    got = cpe.fuzzy_terms(texts, "id", "t", terms, "term").collect()
    assert {(r["term"], r["word"], r["score"]) for r in got} == want
    assert {r["n"] for r in got if r["word"] == "apache"} == {2}


@pytest.mark.parametrize("threshold", [40, 60, 69, 70, 71, 85, 99])
def test_fuzzy_terms_at_the_edge(spark, threshold):
    from corrspark.functions.words import ratio

    pick = random.Random(threshold)
    words = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(1, 12))) for _ in range(150)})
    needles = sorted({"".join(pick.choice("abc") for _ in range(pick.randrange(1, 12))) for _ in range(40)} | set(words[:5]))
    texts = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, t string")
    got = cpe.fuzzy_terms(texts, "id", "t", spark.createDataFrame([(n,) for n in needles], "term string"), "term", threshold).collect()
    assert sorted((r["term"], r["word"], r["score"]) for r in got) == sorted((n, w, ratio(w, n)) for n in needles for w in words if ratio(w, n) > threshold)
