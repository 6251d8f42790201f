"""URL filters with link-graph propagation (operator 6, DataFrame functions only).

Rules decide the urls they fit; the longest wins. For all others the host decides:
trust spreads by personalised PageRank from hosts with allowed pages along links,
distrust from hosts with blocked pages against the links (a host that links to bad
hosts is suspect), and a host is blocked where its distrust is above ``THRESHOLD``
times its trust. A host without either is allowed.

Host edges: every href of a page (relative ones stay on the host), and one edge each
way between a host and its parent domain. Edges are summed per pair of hosts before
they are used; ranks and edges are joined in Spark, and every ``ROUNDS_WRITTEN``
rounds are written to the shared folder, so a lost executor costs no more. Rounds end when none of them
adds more than ``TOLERANCE`` of its rank to any host, so a host at any distance from
the seeds has its rank; links of a host to itself are solved for, not iterated.

Edge cases: a url that is null or has no ``://`` has an empty host and path and fits
no rule; null html has no links; repeated pages count as often as they stand; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.session import materialise

#: (verdict, host and path): a few hundred at most, they become one expression.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 1.0
#: Rounds of one job.
ROUNDS_WRITTEN = 8
#: Rounds that the SQL writes out; it is not iterated to the tolerance.
ROUNDS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\bhref\s*=\s*["']([^"']*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of the longest fitting rule and its verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, found`` and the html."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html"))
    return parts.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` from links and parent domains."""
    href = F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))
    target = F.translate(F.regexp_extract("_href", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), _UPPER, _LOWER)
    other = F.regexp_like("_href", F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//)"))  # mailto:, javascript:
    links = (
        pages.where("host <> ''").select("host", href.alias("_href")).where(~other)
        .select(F.col("host").alias("src"), F.when(target == "", F.col("host")).otherwise(target).alias("dst"))
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    )
    hosts = links.select(F.col("src").alias("h")).union(links.select("dst")).union(pages.where("host <> ''").select("host")).distinct()
    labels = F.split("h", r"\.")
    domains = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("h")).distinct()
    below = domains.where(F.instr("h", ".") > 0).select(F.col("h").alias("src"), F.regexp_replace("h", r"^[^.]*\.", "").alias("dst")).where("dst <> ''")
    ties = below.union(below.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return links.union(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` from ``seeds`` (host, trust, distrust; each sums to 1 or 0).

    Trust follows edges, distrust goes against them; both run in one pass per round. A
    rank is the sum of what reaches its host over paths of every length. ``step`` is
    what the last round brought, ``total`` all so far, both before the division by
    ``stay``, which sums up the turns of a host's links to itself.
    """
    way = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0))
    out = materialise(way.groupBy("kind", "src").agg(F.sum("weight").alias("out"), (1 - damping * own / F.sum("weight")).alias("stay")), "out")
    shares = way.where("src <> dst").join(out, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("weight") / F.col("out") / F.col("stay")).alias("share"))
    start = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "score")).where("score > 0")
    step = F.col("score") * (1 - damping)
    ranks = materialise(start.select("kind", "host", step.alias("step"), step.alias("total")), "seeds")
    # a row without a share hands on the total of a host: a round reads the ranks once
    hosts = way.select("kind", "src").union(way.select("kind", "dst")).union(ranks.select("kind", "host")).distinct()
    ways = materialise(shares.unionByName(hosts.select("kind", "src", F.col("src").alias("dst")), allowMissingColumns=True), "shares")
    moves = F.col("share").isNotNull()
    while ranks.where(F.col("step") > tolerance * F.col("total")).limit(1).count():
        for _ in range(ROUNDS_WRITTEN):
            moved = ways.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), F.when(moves, F.col("share") * F.col("step")).otherwise(0.0).alias("step"), F.when(moves, 0.0).otherwise(F.col("total")).alias("total"))
            ranks = moved.groupBy("kind", "host").agg(F.sum("step").alias("step"), (F.sum("total") + F.sum("step")).alias("total"))
        ranks = materialise(ranks, "ranks")
    ranks = ranks.join(out.select("kind", F.col("src").alias("host"), "stay"), ["kind", "host"], "left").withColumn("score", F.col("total") / F.coalesce("stay", F.lit(1.0)))
    return ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    judged = judged_pages(pages, rules)
    seen = judged.where("host <> '' and found is not null").groupBy("host").agg(
        *(F.sum(F.when(F.col("found.verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")))
    both = seen.groupBy().agg(F.sum("allow").alias("a"), F.sum("block").alias("b")).first()  # two numbers
    share = lambda c, n: (F.col(c) / n) if n else F.lit(0.0)
    seeds = seen.select("host", share("allow", both["a"]).alias("trust"), share("block", both["b"]).alias("distrust"))
    ranks = propagate(host_edges(judged), seeds)
    blocked = ranks.where(F.col("distrust") > threshold * F.col("trust")).select("host", F.lit("block").alias("_host_verdict"))
    return judged.drop("html").join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "_host_verdict", F.lit("allow")).alias("verdict"))


def _sql() -> str:
    """The same in SQL, the rounds written out."""
    rule = "NULL"
    verdict = "NULL"
    for v, r in sorted(RULES, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, start = r.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    rounds = "".join(
        f""", r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT s.kind, s.dst AS host, s.share * r.score AS score FROM shares s JOIN r{k} r ON s.kind = r.kind AND s.src = r.host
  UNION ALL SELECT kind, host, score * {1 - DAMPING} FROM r0) GROUP BY kind, host)""" for k in range(ROUNDS))
    return rf"""
WITH p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {verdict} AS found FROM p),
h AS (SELECT host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']([^"'']*)', 1)) AS href FROM p WHERE host <> ''),
l AS (SELECT host AS src, translate(regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS t FROM h
      WHERE NOT (regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*://'))),
links AS (SELECT src, CASE WHEN t = '' THEN src ELSE t END AS dst, count(*) AS weight FROM l GROUP BY ALL),
hosts AS (SELECT src AS h FROM links UNION SELECT dst FROM links UNION SELECT host FROM p WHERE host <> ''),
parts AS (SELECT DISTINCT array_to_string(list_slice(string_split(h, '.'), k, 1000), '.') AS h FROM (SELECT h, unnest(range(1, len(string_split(h, '.')) + 1)) AS k FROM hosts)),
below AS (SELECT h AS src, regexp_replace(h, '^[^.]*\.', '') AS dst FROM parts WHERE contains(h, '.')),
e AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM below WHERE dst <> '' UNION ALL SELECT dst, src, 1 FROM below WHERE dst <> '') GROUP BY ALL),
way AS (SELECT 'trust' AS kind, src, dst, weight FROM e UNION ALL SELECT 'distrust', dst, src, weight FROM e),
shares AS (SELECT kind, src, dst, {DAMPING} * weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM way),
seen AS (SELECT host, sum(CASE WHEN found = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN found = 'block' THEN 1 ELSE 0 END) AS b FROM j WHERE host <> '' AND found IS NOT NULL GROUP BY host),
r0 AS (SELECT * FROM (SELECT 'trust' AS kind, host, a / sum(a) OVER () AS score FROM seen UNION ALL SELECT 'distrust', host, b / sum(b) OVER () FROM seen) WHERE score > 0){rounds},
bad AS (SELECT host FROM r{ROUNDS} GROUP BY host HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) > {THRESHOLD} * sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END))
SELECT page_id, host, path, rule, coalesce(found, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


SQL = _sql()
