"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 8).

Targets are weights under a ceiling. Blocks of equally many words are allotted to
sources by highest quotients ``target / (2 j + 1)``, first to last; shard m of the
mix takes the blocks between two house sizes, so it has an integer quota of every
source (the method never takes a seat back as the house grows). Inside a source,
documents stand in a seeded order; its words in that order are cut into blocks, and
a quota of q takes blocks 0 to q - 1, going round again behind the last word.
Block ``first_block`` to ``first_block + n_blocks - 1`` of a source are in the shard
whose quota they are, so every word of the mix has its shard. DataFrame functions only.

Edge cases: null texts and texts without words have size 0 and are never taken;
the null source is a source, ordered last; repeated rows are rows of their own; one
source, equal weights and an empty table work; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.common import DRAWS, WORD, group_key, running, seeded

WEIGHTS, SHARE_PERCENT, MOST, BLOCK_WORDS, SHARDS, SEED = (5, 2, 1), 150, 2, 64, 16, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Target words per source from ``_source`` (group key) and ``source_size``.

    Resharing the excess until no source is above its ceiling ends where every
    target is min(ceiling, level * weight). Sources in order of ceiling / weight
    reach their ceiling first, so the level follows from running sums.
    One row per source: this table is small beside the documents.
    """
    null_last, by_name = F.col("_source") == "n", F.col("_source")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(null_last, by_name)) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_place") % len(weights)).cast("int") + 1)
    named = sources.withColumn("_place", place).withColumn("weight", weight)
    up = Window.partitionBy(F.lit(0)).orderBy(F.expr(f"source_size * {most} / weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = (
        named.withColumn("_words", F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("source_size").over(up), F.lit(0)) * most)
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
        # the share of this source if all before it are at their ceiling, times 100 to stay whole
        .withColumn("_left", F.col("_words") * share_percent - F.col("_capped") * 100)
        .withColumn("_full", F.col("_left") * F.col("weight") >= F.col("source_size") * most * 100 * F.col("_open"))
        .withColumn("_level", F.min(F.when(~F.col("_full"), F.struct(F.expr(f"source_size * {most} / weight"), "_place", "_left", "_open"))).over(everything))
    )
    target = F.when(
        F.col("_full"), (F.col("source_size") * most).cast("double")
    ).otherwise(F.col("_level._left") * F.col("weight") / (F.col("_level._open") * 100))
    return levels.select("_source", "source_size", target.alias("target"))


def quotas(aims: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``_source, shard, first_block, n_blocks``: blocks of every source per shard of the mix.

    Shards are houses of growing size. For a house, the divisor total / house gives
    every source its rounded share; at most half a seat per source is then still to
    be given or taken back. Those last seats go by highest quotients among
    candidates around the share; a source gets as many candidates as its part of
    all open seats allows, so there are a few per source.
    """
    everything = Window.partitionBy(F.lit(0))
    house = Window.partitionBy("shard")
    shares = (
        aims.withColumn("_total", F.sum("target").over(everything))
        .withColumn("_sources", F.count(F.lit(1)).over(everything))
        .where(F.col("target") > 0)
        .withColumn("_part", F.col("target") / F.col("_total"))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("_house", F.floor(F.round(F.col("_total") / block) * F.col("shard") / shards).cast("long"))
        .withColumn("_share", F.floor(F.col("_part") * F.col("_house")).cast("long"))
        .withColumn("_reach", F.ceil(1.5 * F.col("_sources") * F.col("_part")).cast("long") + 2)
        .withColumn("_low", F.greatest(F.lit(0), F.col("_share") - F.col("_reach")))
        .withColumn("_open", F.col("_house") - F.sum("_low").over(house))
    )
    candidates = shares.withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_share") + F.col("_reach"))))
    order = house.orderBy((F.col("target") / (2 * F.col("_seat") + 1)).desc(), "_source", "_seat")
    seats = (
        candidates.withColumn("_won", (F.row_number().over(order) <= F.col("_open")).cast("long"))
        .groupBy("_source", "shard").agg((F.first("_low") + F.sum("_won")).alias("_upto"))
    )
    before = F.coalesce(F.lag("_upto").over(Window.partitionBy("_source").orderBy("shard")), F.lit(0))
    return seats.select("_source", (F.col("shard") - 1).alias("shard"), before.alias("first_block"), (F.col("_upto") - before).alias("n_blocks"))


def mix(docs: DataFrame, seed: str = SEED, block: int = BLOCK_WORDS, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row, ``copies`` and ``shards``.

    ``taken`` counts the words of the document inside taken blocks, repeats
    included. ``copies`` is how often the document itself goes into the mix: once
    for every pass in which its first word is taken. ``shards`` says how many of the
    taken words each shard holds, as ``shard:words`` by shard, comma-joined.
    """
    rows = docs.select(F.col("doc_id"), word_count(F.col("text")).alias("_size"), group_key(F.col("source")).alias("_source"))
    placed = _placed(rows, seed, block, shards, most)
    return placed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), _taken().alias("taken"), _copies().alias("copies"), _dealt(most).alias("shards"))


def apply(docs: DataFrame, seed: str = SEED, shard: str | None = None) -> DataFrame:
    """The mix as rows of ``docs``: every row once per copy, with its own columns.

    ``shard`` names a further column for the shard that a copy's first word is in.
    """
    own = [c for c in docs.columns]
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col("doc_id"), word_count(F.col("text")).alias("_size"), group_key(F.col("source")).alias("_source"))
    placed = _placed(kept, seed, BLOCK_WORDS, SHARDS, MOST).where(_copies() > 0)
    copied = placed.select("_row", "_bounds", "_start", "_source_size", F.explode(F.sequence(F.lit(0).cast("long"), _copies() - 1)).alias("_pass"))
    if shard is None:
        return copied.select("_row.*")
    first = F.col("_pass") * F.col("_source_size") + F.col("_start")
    return copied.withColumn("_shard", F.size(F.filter("_bounds", lambda b: b <= first))).select("_row.*", F.col("_shard").alias(shard))


def _placed(rows: DataFrame, seed: str, block: int, shards: int, most: int) -> DataFrame:
    """Rows with their place among the words of their source, its quota and target."""
    aims = targets(rows.groupBy("_source").agg(F.sum("_size").alias("source_size")), most=most)
    # the last word of every shard's blocks, in the order of the source's words
    ends = F.sort_array(F.collect_list(F.struct("shard", ((F.col("first_block") + F.col("n_blocks")) * block).alias("end"))))
    allotted = quotas(aims, block, shards).groupBy("_source").agg(ends.alias("_ends"))
    bounds = F.transform(F.coalesce("_ends.end", F.array().cast("array<long>")), lambda end: F.least(end, F.col("source_size") * most))
    plan = aims.join(allotted, "_source", "left").withColumn("_bounds", bounds).withColumn("_quota", F.coalesce(F.array_max("_bounds"), F.lit(0)))
    turns = F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.expr("_quota % source_size")).otherwise(F.lit(0))
    facts = plan.select("_source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), turns.alias("_turns"), rest.alias("_rest"), "_bounds")
    drawn = rows.withColumn("_draw", seeded(seed, F.col("doc_id")))
    order = [F.col("_draw"), F.col("doc_id"), F.col("_size")]
    return running(drawn, "_source", F.col("_draw") / DRAWS, order, F.col("_size"), "_start", "_words", facts=facts)


def _taken() -> Column:
    return (F.col("_turns") * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start")))).cast("long")


def _dealt(most: int) -> Column:
    def words(end: Column, shard: Column) -> Column:
        before = F.coalesce(F.get("_bounds", shard - 1), F.lit(0))
        inside = []
        for turn in range(most):
            begin = F.col("_source_size") * turn + F.col("_start")
            inside.append(F.greatest(F.lit(0), F.least(end, begin + F.col("_size")) - F.greatest(before, begin)))
        return sum(inside[1:], inside[0])

    held = F.transform("_bounds", lambda end, shard: F.struct(shard.alias("shard"), words(end, shard).alias("words")))
    return F.array_join(F.transform(F.filter(held, lambda x: x["words"] > 0), lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")


def _copies() -> Column:
    again = ((F.col("_start") < F.col("_rest")) & (F.col("_size") > 0)).cast("long")
    return F.when(F.col("_size") > 0, F.col("_turns") + again).otherwise(F.lit(0)).cast("long")


SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS draw FROM documents),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, row_number() OVER (ORDER BY src = 'n', src) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s1),
s3 AS (SELECT *, source_size * {MOST} / weight AS ratio FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () AS words,
         coalesce(sum(source_size) OVER up, 0) * {MOST} AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS open
       FROM s3 WINDOW up AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, CAST(words * {SHARE_PERCENT} - capped * 100 AS BIGINT) AS rest FROM s4),
s6 AS (SELECT *, rest * weight >= source_size * {MOST} * 100 * open AS filled FROM s5),
lv AS (SELECT rest, open FROM s6 WHERE NOT filled ORDER BY ratio, place LIMIT 1),
aim AS (SELECT src, source_size, CASE WHEN filled THEN CAST(source_size * {MOST} AS DOUBLE)
          ELSE CAST(lv.rest * weight AS DOUBLE) / CAST(lv.open * 100 AS DOUBLE) END AS target FROM s6 LEFT JOIN lv ON true),
k AS (SELECT CAST(round(sum(target) / {BLOCK_WORDS}) AS BIGINT) AS blocks, count(*) AS n, sum(target) AS total FROM aim),
q AS (SELECT src, unnest(range(0, CAST(ceil(target / {BLOCK_WORDS}) AS BIGINT) + 3 + 2 * n)) AS j, target FROM aim, k WHERE target > 0),
won AS (SELECT src, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, src, j) AS r FROM q),
seats AS (SELECT src, m, count(*) FILTER (r <= blocks * (m + 1) // {SHARDS}) AS upto FROM won, k, range({SHARDS}) AS h(m) GROUP BY src, m),
house AS (SELECT src, m, least(upto * {BLOCK_WORDS}, source_size * {MOST}) AS hi,
            coalesce(lag(least(upto * {BLOCK_WORDS}, source_size * {MOST})) OVER (PARTITION BY src ORDER BY m), 0) AS lo FROM seats JOIN aim USING (src)),
plan AS (SELECT aim.*, coalesce(quota, 0) AS quota FROM aim LEFT JOIN (SELECT src, max(hi) AS quota FROM house GROUP BY src) USING (src)),
p AS (SELECT row_number() OVER () AS rid, src, d.doc_id, d.size, source_size, target, quota, CAST(coalesce(sum(d.size) OVER w, 0) AS BIGINT) AS start
      FROM d JOIN plan USING (src) WINDOW w AS (PARTITION BY src ORDER BY draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS turns,
             CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest FROM p),
held AS (SELECT rid, m, sum(greatest(0, least(hi, g * source_size + start + size) - greatest(lo, g * source_size + start))) AS n
         FROM r JOIN house USING (src), range({MOST}) AS t(g) GROUP BY rid, m),
dealt AS (SELECT rid, string_agg(m || ':' || CAST(n AS BIGINT), ',' ORDER BY m) AS shards FROM held WHERE n > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(turns * size + least(size, greatest(0, rest - start)) AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN turns + CASE WHEN start < rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies,
       coalesce(shards, '') AS shards FROM r LEFT JOIN dealt USING (rid)
"""
