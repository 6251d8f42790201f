"""Small feeds and catalogues, written by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corrspark.operators import tasks
from corrspark.plans import correlate, encode, refresh
from corrspark.sources import catalogues, inputs, writers


def item(cid, text, lang="en", cwe="CWE-79", day="2020-01-02T03:04Z"):
    return {
        "cve": {
            "CVE_data_meta": {"ID": cid, "ASSIGNER": "x"},
            "description": {"description_data": [{"lang": "es", "value": "nada"}, {"lang": lang, "value": text}]},
            "references": {"reference_data": [{"url": "http://u", "name": "n" + text, "refsource": "R", "tags": ["T"]}, {"url": "http://v"}]},
            "problemtype": {"problemtype_data": [{"description": [{"lang": "en", "value": cwe}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}]},
        },
        "impact": {"baseMetricV3": {"cvssV3": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}},
        "configurations": {"nodes": [{"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:a"}, {"vulnerable": False, "cpe23Uri": "cpe:b"}],
                                      "children": [{"cpe_match": [{"vulnerable": True, "cpe23Uri": "cpe:child"}]}]}, {}]},
        "publishedDate": day, "lastModifiedDate": day,
    }


@pytest.fixture(scope="module")
def feed_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")
    head = {"CVE_data_type": "CVE", "CVE_data_format": "MITRE", "CVE_data_version": "4.0"}
    old = {**head, "CVE_data_timestamp": "2021-01-01T07:00Z", "CVE_Items": [item("CVE-2020-0001", "first"), item("CVE-2020-0002", "foreign", "fr"), item("CVE-2020-0003", "plain")]}
    new = {**head, "CVE_data_timestamp": "2022-05-06T07:00Z", "CVE_Items": [item("CVE-2020-0001", "second", cwe="CWE-1")]}
    (path / "nvdcve-1.1-2020.json").write_text(json.dumps(old))
    (path / "nvdcve-1.1-2021.json").write_text(json.dumps(new))
    return str(path)


CAPEC_XML = """<?xml version="1.0"?>
<Attack_Pattern_Catalog xmlns="http://capec.mitre.org/capec-3" xmlns:xhtml="http://www.w3.org/1999/xhtml" Name="CAPEC" Version="3.9" Date="2023-01-24"><Attack_Patterns>
<Attack_Pattern ID="1" Name="SQL Injection" Abstraction="Standard" Status="Draft">
 <Description>An <xhtml:b>adversary</xhtml:b> injects
   &lt;script&gt; code.</Description><Likelihood_Of_Attack>High</Likelihood_Of_Attack>
 <Execution_Flow>
  <Attack_Step><Step>1</Step><Phase>Explore</Phase><Description>Look.</Description><Technique>Scan <xhtml:i>all</xhtml:i></Technique><Technique CAPEC_ID="3">Ask</Technique></Attack_Step>
  <Attack_Step><Step>1</Step><Phase>Exploit</Phase><Description>Do.</Description></Attack_Step>
  <Attack_Step><Step>2</Step><Phase>Exploit</Phase><Description>End.</Description></Attack_Step>
 </Execution_Flow>
 <Prerequisites><Prerequisite>A database</Prerequisite><Prerequisite>An input</Prerequisite></Prerequisites>
 <Skills_Required><Skill Level="Low">Know <xhtml:i>SQL</xhtml:i> well.</Skill><Skill>Patience</Skill></Skills_Required>
 <Consequences><Consequence><Scope>Integrity</Scope><Impact>Modify Data</Impact><Note>Bad</Note></Consequence></Consequences>
 <Alternate_Terms><Alternate_Term><Term>SQLi</Term></Alternate_Term></Alternate_Terms>
 <Related_Attack_Patterns><Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="2"/><Related_Attack_Pattern Nature="PeerOf" CAPEC_ID="2"/><Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="99"/></Related_Attack_Patterns>
</Attack_Pattern>
<Attack_Pattern ID="2" Name="Overflow" Abstraction="Meta" Status="Stable"><Description>Too long.</Description></Attack_Pattern>
<Attack_Pattern ID="3" Name="Old" Abstraction="Meta" Status="Deprecated"><Description>Gone</Description></Attack_Pattern>
<Attack_Pattern ID="4" Name="No status" Abstraction="Meta"><Description>Kept</Description></Attack_Pattern>
</Attack_Patterns></Attack_Pattern_Catalog>"""

CWE_XML = """<?xml version="1.0"?>
<Weakness_Catalog xmlns="http://cwe.mitre.org/cwe-7" xmlns:xhtml="http://www.w3.org/1999/xhtml" Name="CWE" Version="4.15" Date="2024-07-16"><Weaknesses>
<Weakness ID="79" Name="XSS" Abstraction="Base" Structure="Simple" Status="Stable"><Description>Bad output</Description>
 <Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="1" View_ID="1000"/><Related_Weakness Nature="ChildOf" CWE_ID="1" View_ID="1003"/><Related_Weakness Nature="PeerOf" CWE_ID="500" View_ID="1000"/></Related_Weaknesses>
 <Applicable_Platforms><Language Class="Not Specific" Prevalence="Often"/><Technology Name="Web"/></Applicable_Platforms>
 <Demonstrative_Examples><Demonstrative_Example><Intro_Text>See</Intro_Text><Body_Text>one</Body_Text><Example_Code Nature="Bad" Language="PHP"><xhtml:div>echo</xhtml:div></Example_Code><Body_Text>two</Body_Text></Demonstrative_Example></Demonstrative_Examples>
 <Potential_Mitigations><Mitigation><Phase>Design</Phase><Phase>Build</Phase><Description>Encode <xhtml:b>all</xhtml:b></Description></Mitigation></Potential_Mitigations>
 <Observed_Examples><Observed_Example><Reference>CVE-2020-0001</Reference><Description>seen</Description></Observed_Example></Observed_Examples>
 <Related_Attack_Patterns><Related_Attack_Pattern CAPEC_ID="1"/><Related_Attack_Pattern CAPEC_ID="77"/></Related_Attack_Patterns>
</Weakness>
<Weakness ID="1" Name="One" Abstraction="Pillar" Structure="Simple" Status="Draft"><Description>Root</Description></Weakness>
<Weakness ID="2" Name="Two" Abstraction="Class" Structure="Simple" Status="Draft"><Description>Other</Description></Weakness>
</Weaknesses></Weakness_Catalog>"""


@pytest.fixture(scope="module")
def capecs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("capec") / "capec.xml"
    path.write_text(CAPEC_XML)
    return refresh.capec_tables(spark, str(path))


@pytest.fixture(scope="module")
def cwes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cwe") / "cwe.xml"
    path.write_text(CWE_XML)
    return refresh.cwe_tables(spark, str(path))


def test_feed(spark, feed_dir, rows):
    got = refresh.cve_tables(spark, feed_dir)
    table = {r["id"]: r for r in got["cve"].collect()}
    assert {k: v["description"] for k, v in table.items()} == {"CVE-2020-0001": "second", "CVE-2020-0003": "plain"}
    row = table["CVE-2020-0001"]
    assert (row["vulnerable_cpe_uris"], row["related_cpe_uris"]) == (["cpe:a"], ["cpe:b"])
    assert row["impact_v3"]["cvssV3"]["baseScore"] == 9.8 and row["impact_v2"] is None
    assert rows(got["quarantine"], "id") == [("CVE-2020-0002",)]
    assert got["version"].first()["version"] == "2022-05-06"
    refs = rows(got["cve_reference"].filter("cve_id = 'CVE-2020-0001'").na.fill(""), "url", "name")
    assert refs == [("http://u", "nsecond"), ("http://v", "")]
    old = spark.createDataFrame([r.asDict() for r in table.values()], got["cve"].schema)
    again = refresh.cve_tables(spark, feed_dir, old)["cve"]
    assert sorted(map(str, again.collect())) == sorted(map(str, table.values()))


def test_capec(spark, capecs, rows):
    row = {r["id"]: r for r in capecs["capec"].collect()}["CAPEC-1"]
    assert row["description"] == "An adversary injects <script> code."
    assert [(s["Level"], s["Description"]) for s in row["skills_required"]] == [("Low", "Know SQL well."), (None, "Patience")]
    assert row["prerequisites_aggregated"] == "A database An input"
    assert row["overall_aggregated_text"].startswith("An adversary injects <script> code.  ")
    steps = rows(capecs["attack_step"], "pos", "step", "phase", "techniques_aggregated")
    assert steps == [(0, "1", "Explore", "Scan all Ask"), (1, "1b", "Exploit", ""), (2, "2", "Exploit", "")]
    assert rows(capecs["capec_related_pattern"]) == [("CAPEC-1", "CAPEC-2", "PeerOf")]
    versions = capecs["preprocessed_capec"]
    assert versions.count() == 16
    stem = versions.filter("id = 'CAPEC-1' and preprocessed_version = 'Stemming'").first()
    assert stem["name"] == "sql inject" and stem["consequences"] == ["scope integr impact modifi data note bad"]
    assert capecs["preprocessed_attack_step"].count() == 12
    assert tuple(capecs["version"].first()) == ("CAPEC", "3.9", "2023-01-24")


def test_cwe(spark, cwes, rows):
    table = {r["id"]: r for r in cwes["cwe"].collect()}
    assert set(table) == {"CWE-79", "CWE-1", "CWE-2", "CWE-500"} and table["CWE-500"]["name"] is None
    assert rows(cwes["cwe_related_weakness"]) == [("CWE-79", "CWE-1", "ChildOf"), ("CWE-79", "CWE-500", "PeerOf")]
    example = table["CWE-79"]["demonstrative_examples"][0]
    assert example["Body_Texts"] == ["one", "two"]
    assert tuple(example["Example_Codes"][0]) == ("Bad", "PHP", "echo")
    assert [p["Type"] for p in table["CWE-79"]["applicable_platforms"]] == ["Language", "Technology"]
    assert table["CWE-79"]["potential_mitigations"][0]["Description"] == "Encode all"


def test_refresh_on_old_tables(spark, capecs, cwes, tmp_path, rows, feed_dir):
    """A second file replaces what it holds and keeps the rest, with steps and edges."""
    path = tmp_path / "again.xml"
    path.write_text(CAPEC_XML)
    again = refresh.capec_tables(spark, str(path), capecs)
    assert again["capec"].count() == capecs["capec"].count()
    assert sorted(map(str, again["attack_step"].collect())) == sorted(map(str, capecs["attack_step"].collect()))
    extra = spark.createDataFrame([("CAPEC-900", "CAPEC-1", "ChildOf")], "source string, target string, nature string")
    old = capecs | {"capec_related_pattern": capecs["capec_related_pattern"].union(extra)}
    assert rows(refresh.capec_tables(spark, str(path), old)["capec_related_pattern"]) == [("CAPEC-1", "CAPEC-2", "PeerOf"), ("CAPEC-900", "CAPEC-1", "ChildOf")]
    got = refresh.cve_tables(spark, feed_dir)
    refs = got["cve_reference"]
    gone = refs.limit(1).withColumn("cve_id", F.lit("CVE-1999-0001"))
    kept = refresh.cve_tables(spark, feed_dir, got["cve"], refs.unionByName(gone))["cve_reference"]
    assert kept.count() == refs.count() + 1


def test_links(spark, feed_dir, capecs, cwes, rows):
    bridges = refresh.link_tables(refresh.cve_tables(spark, feed_dir), cwes, capecs)
    # both feed files link the repeated record, the quarantined one is no end
    assert rows(bridges["cve_cwe"]) == [("CVE-2020-0001", "CWE-1"), ("CVE-2020-0001", "CWE-79"), ("CVE-2020-0003", "CWE-79")]
    assert rows(bridges["cwe_capec"]) == [("CWE-79", "CAPEC-1")]


def test_links_are_kept_over_refreshes(spark, rows):
    """Three rounds of random changes: the carried-on links equal those built anew."""
    pick = random.Random(6)
    ids = lambda names: spark.createDataFrame([(n,) for n in sorted(names)] or [(None,)], "id string").filter("id is not null")
    pairs = lambda xs: spark.createDataFrame(sorted(xs) or [(None, None)], "cve_id string, cwe_id string").filter("cve_id is not null")
    left, right, mentions = set(), set(), {}
    bridges = before = None
    for _ in range(4):
        feed = {f"V{pick.randrange(30)}" for _ in range(12)}
        old_left, old_right = set(left), set(right)
        left = (left | feed) - {f"V{pick.randrange(30)}" for _ in range(4)} - ({pick.choice(sorted(feed))} if bridges else set())
        right = {f"W{k}" for k in range(8) if pick.random() < 0.6}
        mentions |= {v: {f"W{pick.randrange(8)}" for _ in range(pick.randrange(3))} for v in feed}
        said = {(v, w) for v, ws in mentions.items() for w in ws}
        cves = {"cve": ids(left), "weakness_mentions": pairs(said), "refreshed": ids(feed)}
        cwes = {"cwe": ids(right), "pattern_mentions": spark.createDataFrame([], "cwe_id string, capec_id string"), "refreshed": ids(right)}
        got = refresh.link_tables(cves, cwes, {"capec": ids(right)}, bridges, before)["cve_cwe"]
        assert rows(got) == sorted((v, w) for v, w in said if v in left and w in right)
        bridges = {"cve_cwe": spark.createDataFrame(got.collect(), got.schema)}
        before = {"cve": ids(left), "cwe": ids(right)}


def test_mentions_of_earlier_feeds_stay(spark, feed_dir, capecs, cwes, rows, tmp_path):
    first = refresh.cve_tables(spark, feed_dir)
    again = refresh.cve_tables(spark, feed_dir, first["cve"], first["cve_reference"], first["weakness_mentions"].unionByName(
        spark.createDataFrame([("CVE-1999-0001", "CWE-79"), ("CVE-2020-0001", "CWE-1000")], "cve_id string, cwe_id string")))
    old = first["weakness_mentions"].distinct()
    assert set(rows(again["weakness_mentions"].distinct())) - set(rows(old)) == {("CVE-1999-0001", "CWE-79")}


def test_wrong_catalogue_is_an_error(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text(CAPEC_XML.replace('Name="CAPEC"', 'Name="Other"'))
    with pytest.raises(Exception, match="not a valid CAPEC"):
        catalogues.capec_header(spark, str(path)).collect()


def test_inputs(spark, tmp_path, rows):
    sheets = tmp_path / "hosts"
    sheets.mkdir()
    (sheets / "web.csv").write_text("CVE-2020-9999,x\nCVE-2020-0001,note\n")
    (sheets / "db.csv").write_text("id\r\nCVE-2020-0001\r\n CVE-2020-0002\r\n\"CVE-2020-00031\"\r\n")
    assert rows(inputs.read_host_sheets(spark, str(sheets))) == [("db", "CVE-2020-0001"), ("db", "CVE-2020-00031"), ("web", "CVE-2020-0001")]
    assert rows(inputs.read_id_csv(spark, str(sheets / "web.csv"))) == [("CVE-2020-0001",), ("CVE-2020-9999",)]
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps([{"CVE_ID": "a", "Assigned_CAPEC_ID": ["x"]}, {"CVE_ID": "a", "Assigned_CAPEC_ID": ["y", "z"]}, {"CVE_ID": "b"}, {"Assigned_CAPEC_ID": ["q"]}]))
    assert rows(inputs.read_truth(spark, str(truth))) == [("a", "y"), ("a", "z")]
    asked = inputs.requests(spark.createDataFrame([("a",), ("a",)], "cve_id string"), "t")
    assert rows(asked) == [("t", "a", "Generic")]
    assert len(inputs.acronym_map(inputs.acronym_table(spark))) == 50
    listed = tmp_path / "acronyms.json"
    listed.write_text(json.dumps({"acronyms": {"B": ["bee"], "A": ["ay", "ey"]}}))
    assert inputs.acronym_map(inputs.acronym_table(spark, str(listed))) == {"B": ["bee"], "A": ["ay", "ey"]}
    assert spark.createDataFrame([("CVE-2020-0001, x,CVE-1-2",)], "t string").transform(lambda d: inputs.ids_from_text(d, "t")).count() == 1


def test_whole_correlation(spark, feed_dir, capecs, tmp_path):
    """Feed and catalogue to results: clean, encode, score, fuse, rank, complete."""
    cves = refresh.cve_tables(spark, feed_dir)["cve"].withColumn(
        "description", F.when(F.col("id") == "CVE-2020-0001", "SQL injection 1.2 in the login page").otherwise(F.col("description")))
    asked = inputs.requests(spark.createDataFrame([("CVE-2020-0001",), ("CVE-2020-0003",), ("CVE-2000-1111",)], "cve_id string"), "t")
    basic = capecs["preprocessed_capec"].filter("preprocessed_version = 'Basic'")
    steps = capecs["preprocessed_attack_step"].filter("preprocessed_version = 'Basic'")
    count = lambda texts: [[t.count(c) + 0.01 for c in "abcdeilnoqstu"] for t in texts]
    encoders = {"letters": encode.encode_with(lambda: count), "hashed": encode.encode_once(encode.encode_hashed(32))}
    results, errors = correlate.correlate(asked, cves, basic, encoders, steps, task_id="t")
    got = results.collect()
    # two ids, three active patterns, two models and their keyword variants
    assert len(got) == 2 * 3 * 4
    best = {r["model"]: r["capec_id"] for r in got if r["cve_id"] == "CVE-2020-0001" and r["rank"] == 1}
    assert best["letters_keyword"] == "CAPEC-1"
    by_model = {(r["model"], r["capec_id"]): r["final_score"] for r in got if r["cve_id"] == "CVE-2020-0001"}
    assert by_model["letters_keyword", "CAPEC-1"] == pytest.approx(by_model["letters", "CAPEC-1"] + 0.3)
    assert [tuple(r) for r in errors.collect()] == [("t", "CVE-2000-1111", "not found", None)]
    assert correlate.finish(asked, results).first()["status"] == "in_progress"
    assert correlate.finish(asked.filter("cve_id <> 'CVE-2000-1111'"), results).first()["status"] == "complete"
    out = str(tmp_path / "results")
    writers.write_results(results, out)
    assert spark.read.parquet(out).count() == len(got)
    document = writers.similarity_document(results, ["task_id", "cve_id"]).filter("cve_id = 'CVE-2020-0001'").first()["similarity_scores"]
    assert [p["rank"] for p in document["letters"]] == [1, 2, 3]
    def broken():
        raise RuntimeError("no model")

    again = str(tmp_path / "again")
    failed = correlate.run_task(again, asked, cves, basic, {"bad": encode.encode_with(broken), "letters": encoders["letters"]}, steps=steps, task_id="t")
    assert list(failed) == ["bad"] and spark.read.parquet(again).count() == 2 * 3 * 2
    assert [(r["cve_id"], r["model"]) for r in spark.read.parquet(again + "_errors").collect()] == [("CVE-2000-1111", "letters")]
    correlate.run_task(again, asked, cves, basic, {"letters": encoders["letters"]}, steps=steps, task_id="t")
    stored = spark.read.parquet(again)
    assert stored.count() == 2 * 3 * 2  # a repeated task replaces its rows
    assert {"fields", "field_scores", "execution_flow_score"} <= set(stored.columns)
    best = writers.similarity_document(stored, ["task_id", "cve_id"]).first()["similarity_scores"]["letters"][0]
    assert "description_score" in best["scores"] and best["rank"] == 1
    # a run without any rows leaves none of its task and model behind, but those of others
    writers.write_results(stored.withColumn("task_id", F.lit("other")), again)
    correlate.run_task(again, asked.filter("cve_id = 'CVE-2000-1111'"), cves, basic, {"letters": encoders["letters"]}, steps=steps, task_id="t")
    assert {r["task_id"] for r in spark.read.parquet(again).collect()} == {"other"}
    assert {(r["task_id"], r["model"]) for r in correlate.finished_models(spark.read.parquet(again)).collect()} == {("other", "letters"), ("other", "letters_keyword")}

    def picky():
        def run(texts):
            if any("sql" in t.lower() for t in texts):
                raise ValueError("not this one")
            return [[1.0, float(len(t))] for t in texts]

        return run

    df = spark.createDataFrame([("a", "one"), ("b", "sql here"), ("c", "two"), ("d", None)], "cve_id string, text string")
    vectors = {r["cve_id"]: r["vector"] for r in encode.encode_with(picky)(df).collect()}
    assert vectors == {"a": [1.0, 3.0], "b": None, "c": [1.0, 3.0], "d": None}
    writers.drop_task(str(tmp_path / "kept"), results, spark.createDataFrame([("t",)], "task_id string"))
    kept = writers.read_snapshot(spark, str(tmp_path / "kept"))
    assert kept.count() == 0 and kept.columns == results.columns
    writers.write_report(tasks.top_patterns(asked, results, 1, ["letters"]), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["cve_id", "Rank_1", "Score_1", "host", "model"]
    wide = tasks.top_patterns(asked, results, 2, ["letters"]).first()
    assert wide["host"] == "Generic" and wide["Rank_1"] is not None
    with pytest.raises(ValueError):
        tasks.top_patterns(asked, results, 2, [])


def test_a_second_run_encodes_nothing(spark, tmp_path):
    root = str(tmp_path / "vectors")
    lengths = encode.encode_with(lambda: lambda texts: [[float(len(t))] for t in texts])

    def never():
        raise RuntimeError("nothing is left to encode")

    df = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None)], "id int, text string")
    first = encode.encode_incremental(lengths, root, "m")(df)
    want = [(1, [3.0]), (2, [5.0]), (3, [3.0]), (4, None)]
    assert sorted((r["id"], r["vector"]) for r in first.collect()) == want
    silent = encode.encode_with(lambda: lambda texts: never())
    again = encode.encode_incremental(silent, root, "m")(df)
    assert sorted((r["id"], r["vector"]) for r in again.collect()) == want
    # another model has vectors of its own; a text that can't be encoded has none
    other = encode.encode_incremental(silent, root, "other")(df)
    assert [r["vector"] for r in other.collect()] == [None] * 4
