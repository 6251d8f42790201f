"""Scoring every query vector against a catalogue of pattern vectors.

The catalogue holds one row per pattern field: (capec_id, kind, slot, vector).
``kind`` is "field" or "flow"; ``slot`` names the field or the attack step. A
query's score per pattern is the mean of its field scores, each rounded to
thousandths, and of the flow score: the mean over steps of the better of the
step's two texts. Sums run over whole thousandths, so the result does not depend
on the order in which rows arrive.

The whole query is one map over the query table: products, means, keyword fusion
and ranks, with no shuffle. A catalogue below the broadcast limit is held as a whole.
Of a larger one a task reads one block of whole patterns after the other: with
``top`` it keeps the best rows so far and skips a block for all queries that it can't
help (centre and radius bound its products), with ``wanted`` it counts the better
patterns. Only the full ranking of a large catalogue ranks pairs by a window. Both
ways rank every query row by itself and give the same rows, also for equal and
missing keys. Queries and fields without a vector are left out (see
``without_vector``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corrspark import lexicon
from corrspark.functions.vectors import cosine
from corrspark.operators.blocks import BROADCAST_LIMIT, CELLS, ROW, Loaded, catalogue_blocks, map_blocks, numbered, units_of as _units, vector_bytes

# The pattern fields that are scored.
FIELDS = ("name", "description", "prerequisites", "resources_required", "mitigations", "skills_required")
EXTENDED_FIELDS = FIELDS + ("extended_description", "indicators", "example_instances")


def pair_similarity(pairs: DataFrame, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Cosine of two vector columns of the same row."""
    return pairs.withColumn(out, cosine(F.col(left), F.col(right)))


def one_to_many(df: DataFrame, query: str, names: str, vectors: str, keep: list[str], method: str = "vector") -> DataFrame:
    """Long (field, method, score) rows of one vector against a list of named vectors."""
    same = F.size(names) == F.size(vectors)
    checked = F.when(same, F.arrays_zip(F.col(names).alias("n"), F.col(vectors).alias("v"))).otherwise(
        F.raise_error(F.lit("names and vectors must have the same length"))
    )
    rows = df.select(*keep, F.col(query).alias("_q"), F.explode(checked).alias("_z"))
    return rows.select(*keep, F.col("_z.n").alias("field"), F.lit(method).alias("method"), cosine(F.col("_q"), F.col("_z.v")).alias("score"))


def wide_scores(long_rows: DataFrame, keep: list[str]) -> DataFrame:
    """One map per row: ``<field>_<method>_score`` to score."""
    key = F.concat_ws("_", "field", F.lower("method"), F.lit("score"))
    entries = F.collect_list(F.struct(key, F.col("score")))
    return long_rows.groupBy(*keep).agg(F.map_from_entries(F.array_sort(entries)).alias("scores"))


def field_texts(patterns: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id") -> DataFrame:
    """(capec_id, kind, slot, text) of the non-empty fields of each pattern."""
    pairs = [F.struct(F.lit(f).alias("slot"), F.col(f if f == "name" else f"{f}_aggregated").alias("text")) for f in fields]
    rows = patterns.select(F.col(key).alias("capec_id"), F.explode(F.array(*pairs)).alias("p"))
    return rows.select("capec_id", F.lit("field").alias("kind"), "p.slot", "p.text").filter(F.col("text") != "")


def step_texts(steps: DataFrame, compat: bool = False) -> DataFrame:
    """(capec_id, kind, slot, text): up to two texts per attack step.

    Steps without text are left out. ``compat`` reproduces the known indexing
    slip: with v non-empty steps only the first v positions count, empty ones as
    a zero (a null text).
    """
    both = F.array(F.col("description_aggregated"), F.col("techniques_aggregated"))
    rows = steps.withColumn("_texts", F.filter(both, lambda t: t.isNotNull() & (t != "")))
    rows = rows.withColumn("_full", (F.size("_texts") > 0).cast("int"))
    if compat:
        whole = Window.partitionBy("capec_id")
        rows = (
            rows.withColumn("_i", F.row_number().over(whole.orderBy("pos")))
            .withColumn("_v", F.sum("_full").over(whole))
            .filter(F.col("_i") <= F.col("_v"))
            .withColumn("_texts", F.when(F.col("_full") == 1, F.col("_texts")).otherwise(F.array(F.lit(None).cast("string"))))
        )
    else:
        rows = rows.filter(F.col("_full") == 1)
    return rows.select("capec_id", F.lit("flow").alias("kind"), F.col("step").alias("slot"), F.explode("_texts").alias("text"))


def half_up(x: np.ndarray) -> np.ndarray:
    """Round to whole numbers, halves away from zero (and no negative zero)."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x) + 0.0


def pattern_key(pid: str) -> tuple:
    digits = str(pid).rsplit("-", 1)[-1]
    return (0, int(digits), str(pid)) if digits.isdigit() else (1, 0, str(pid))


def pattern_order(ids) -> list[str]:
    """Tie order of patterns: by number, then by id."""
    return sorted(ids, key=pattern_key)


class Catalogue:
    """A catalogue block laid out for matrix products (lives inside a task)."""

    def __init__(self, rows: pd.DataFrame):
        self.patterns = pattern_order(rows["capec_id"].unique())
        place = {p: i for i, p in enumerate(self.patterns)}
        rows = rows.assign(_p=rows["capec_id"].map(place))
        self.width = len(rows)
        self.order = [pattern_key(p) for p in self.patterns]
        self.fields = rows[(rows["kind"] == "field") & rows["vector"].notna()].sort_values(["_p", "slot"])
        flow = rows[rows["kind"] == "flow"].sort_values(["_p", "slot"])
        self.field_units = _units(self.fields["vector"]) if len(self.fields) else None
        self.n_fields = np.bincount(self.fields["_p"], minlength=len(self.patterns)) if len(self.fields) else np.zeros(len(self.patterns), int)
        self.first_field = np.concatenate(([0], np.cumsum(self.n_fields)))
        self.slots = self.fields["slot"].to_numpy()
        self.flow = None
        if len(flow):
            step = flow.groupby(["_p", "slot"], sort=True)
            self.step_start = np.flatnonzero(~flow.duplicated(["_p", "slot"]).to_numpy())
            self.step_pattern = flow["_p"].to_numpy()[self.step_start]
            # a step with a single text competes with a zero
            self.step_floor = np.where(step.size().to_numpy() < 2, 0.0, -np.inf)
            dim = next((len(v) for v in rows["vector"] if v is not None), 0)
            self.flow = _units([np.zeros(dim) if v is None else v for v in flow["vector"]])
        self.n_steps = np.bincount(self.step_pattern, minlength=len(self.patterns)) if self.flow is not None else np.zeros(len(self.patterns), int)

    def partial(self, vectors, round_fields: bool = True):
        """Per (query, pattern): field sum in thousandths, and step sum; per (query, field) its score in thousandths."""
        queries = _units(vectors)
        shape = (len(queries), len(self.patterns))
        total, steps, scores = np.zeros(shape), np.zeros(shape), np.zeros((len(queries), 0))
        if self.field_units is not None:
            scores = queries @ self.field_units.T * 1000
            scores = half_up(scores) if round_fields else scores
            self._spread(total, scores, self.fields["_p"].to_numpy())
        if self.flow is not None:
            best = np.maximum.reduceat(queries @ self.flow.T, self.step_start, axis=1)
            self._spread(steps, np.maximum(best, self.step_floor), self.step_pattern)
        return total, steps, scores

    @staticmethod
    def _spread(out: np.ndarray, scores: np.ndarray, patterns: np.ndarray) -> None:
        start = np.flatnonzero(np.r_[True, patterns[1:] != patterns[:-1]])
        out[:, patterns[start]] = np.add.reduceat(scores, start, axis=1)


def final_thousandths(total, n_fields, steps, n_steps, flow_weight: int):
    """Final score in thousandths and the flow score."""
    flow = np.divide(steps, n_steps, out=np.zeros_like(steps), where=n_steps > 0)
    if flow_weight > 1:
        flow = half_up(flow * 1000) / 1000
    weight = np.where(flow != 0, flow_weight, 0)
    count = n_fields + weight
    whole = total + flow * 1000 * weight
    mean = np.divide(whole, count, out=np.zeros_like(whole), where=count > 0)
    return half_up(mean).astype(np.int64), flow


def rank_rows(thousandths: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    """Ranks 1..n per row, best first, ties by ``tie`` (default: column order)."""
    n = thousandths.shape[1]
    tie = np.broadcast_to(np.arange(n), thousandths.shape) if tie is None else tie
    order = np.argsort(-thousandths * (n + 1) + tie, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(1, n + 1), order.shape), axis=1)
    return ranks


#: What ``scores`` adds to the rows.
SCORES = "fields array<string>, field_scores array<double>, execution_flow_score double"


class _Scorer:
    """Scores of a batch against a block, as kept cells (lives inside a task)."""

    def __init__(self, key: str, vector: str, model: str, hits: str | None, wanted: str | None, flow_weight: int, round_fields: bool, scores: bool):
        self.key, self.vector, self.model, self.hits, self.wanted = key, vector, model, hits, wanted
        self.flow_weight, self.round_fields, self.scores = flow_weight, round_fields, scores
        self.models = [model, f"{model}_keyword"] if hits else [model]

    def matrices(self, batch: pd.DataFrame, cat: Catalogue):
        """Per model the scores in thousandths, the scores that break all ties, and what makes them up."""
        total, steps, fields = cat.partial(batch[self.vector], self.round_fields)
        base, flow = final_thousandths(total, cat.n_fields, steps, cat.n_steps, self.flow_weight)
        finals = [base, base + _hit_matrix(batch[self.hits], cat.patterns)] if self.hits else [base]
        return finals, base, fields, flow

    def cells(self, batch: pd.DataFrame, cat: Catalogue, top: int | None) -> pd.DataFrame:
        """Cells of a batch that may be in the result: the block's first ones per row, or those wanted."""
        finals, base, fields, flow = self.matrices(batch, cat)
        out, first = [], None
        for name, final in zip(self.models, finals):
            ranks = rank_rows(final, first)
            first = ranks if first is None else first
            keep = np.ones(ranks.shape, dtype=bool) if top is None else ranks <= top
            if self.wanted:
                keep = keep & self._listed(batch, cat)
            row, cell = np.nonzero(keep)
            part = {"_at": row, "model": name, "capec_id": np.asarray(cat.patterns, dtype=object)[cell], "final": final[row, cell], "base": base[row, cell], "rank": ranks[row, cell]}
            if self.scores:
                spans = list(zip(cat.first_field[cell], cat.first_field[cell + 1]))
                flows = flow[row, cell]
                part["fields"] = _objects(cat.slots[a:b] for a, b in spans)
                part["field_scores"] = _objects(fields[r, a:b] / 1000 for r, (a, b) in zip(row, spans))
                part["execution_flow_score"] = np.where(flows != 0, flows, np.nan)
            out.append(pd.DataFrame(part))
        return pd.concat(out, ignore_index=True)

    def _listed(self, batch: pd.DataFrame, cat: Catalogue) -> np.ndarray:
        place = {p: i for i, p in enumerate(cat.patterns)}
        listed = np.zeros((len(batch), len(cat.patterns)), dtype=bool)
        for row, ids in enumerate(batch[self.wanted]):
            listed[row, [place[i] for i in (ids if ids is not None else ()) if i in place]] = True
        return listed

    def rows(self, batch: pd.DataFrame, cells: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
        out = cells.assign(**{c: batch[c].to_numpy()[cells["_at"].to_numpy()] for c in (self.key, ROW) if c in batch})
        out["final_score"], out["rank"] = out["final"] / 1000, out["rank"].astype(np.int32)
        if self.scores:
            out["execution_flow_score"] = out["execution_flow_score"].astype(object).where(out["execution_flow_score"].notna(), None)
        return out[columns]


def _objects(items) -> np.ndarray:
    items = list(items)
    out = np.empty(len(items), dtype=object)
    out[:] = items
    return out


def _first_per_row(cells: pd.DataFrame, top: int | None) -> pd.DataFrame:
    """Cells of several blocks, ranked per row and model; the first ``top`` stay."""
    number = [pattern_key(p) for p in cells["capec_id"]]
    order = np.lexsort((
        cells["capec_id"].to_numpy().astype(str), [n for _, n, _ in number], [k for k, _, _ in number],
        -cells["base"].to_numpy(), -cells["final"].to_numpy(), cells["model"].to_numpy().astype(str), cells["_at"].to_numpy()))
    cells = cells.iloc[order]
    cells = cells.assign(rank=cells.groupby(["_at", "model"], sort=False).cumcount().to_numpy() + 1)
    return cells if top is None else cells[cells["rank"] <= top]


def best_over_blocks(batch: pd.DataFrame, loaded: Loaded, scorer: _Scorer, top: int, cells: int = CELLS) -> pd.DataFrame:
    """The first ``top`` cells of every row and model over all blocks.

    Blocks are taken from the most promising on. A row that has ``top`` cells better
    than all that a block can hold is left out there, and a block that no row needs
    is not read.
    """
    blocks, kept = loaded.blocks, None
    most = np.ceil(1000 * np.maximum(blocks.bounds(_units(batch[scorer.vector])), 0)) + 1
    extra = np.zeros(len(batch))
    if scorer.hits:
        extra = np.array([max([0.0, *(1000 * h["score"] for h in found)]) if found is not None else 0.0 for found in batch[scorer.hits]])
    last = {name: np.full(len(batch), -np.inf) for name in scorer.models}
    for i in np.argsort(-most.sum(axis=0), kind="stable").tolist():
        open_ = np.zeros(len(batch), dtype=bool)
        for name in scorer.models:
            open_ |= most[:, i] + (extra if name != scorer.model else 0) >= last[name]
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        cat = loaded.get(i)
        step = max(1, cells // max(1, cat.width))
        for a in range(0, len(at), step):
            found = scorer.cells(batch.iloc[at[a:a + step]], cat, top)
            found["_at"] = at[a:a + step][found["_at"].to_numpy()]
            kept = found if kept is None else pd.concat([kept, found], ignore_index=True)
        kept = _first_per_row(kept, top)
        for name, of_model in kept[kept["rank"] == top].groupby("model"):
            last[name][of_model["_at"].to_numpy()] = of_model["final"].to_numpy()
    return kept


def wanted_over_blocks(batch: pd.DataFrame, loaded: Loaded, scorer: _Scorer, top: int | None, cells: int = CELLS) -> pd.DataFrame:
    """The wanted cells of every row with their ranks: one more than the better cells of all blocks."""
    blocks, parts = loaded.blocks, []
    order = list(range(len(blocks)))
    for i in order:
        cat = loaded.get(i)
        step = max(1, cells // max(1, cat.width))
        for a in range(0, len(batch), step):
            found = scorer.cells(batch.iloc[a:a + step], cat, None)
            found["_at"] += a
            parts.append(found)
    asked = pd.concat(parts, ignore_index=True)
    asked["rank"] = 1
    most = np.ceil(1000 * np.maximum(blocks.bounds(_units(batch[scorer.vector])), 0)) + 1
    if scorer.hits:
        most = most + np.array([max([0.0, *(1000 * h["score"] for h in found)]) if found is not None else 0.0 for found in batch[scorer.hits]])[:, None]
    ranks, at_of = asked["rank"].to_numpy().copy(), asked["_at"].to_numpy()
    names = asked["model"].to_numpy()
    final_of, base_of, keys = asked["final"].to_numpy(), asked["base"].to_numpy(), [pattern_key(p) for p in asked["capec_id"]]
    for i in reversed(order):
        open_ = np.flatnonzero(most[at_of, i] >= final_of)
        if not len(open_):
            continue
        cat = loaded.get(i)
        rows = np.unique(at_of[open_])
        step = max(1, cells // max(1, cat.width))
        for a in range(0, len(rows), step):
            finals, base, _, _ = scorer.matrices(batch.iloc[rows[a:a + step]], cat)
            local = {r: k for k, r in enumerate(rows[a:a + step].tolist())}
            for c in open_[np.isin(at_of[open_], rows[a:a + step])].tolist():
                k = local[int(at_of[c])]
                final = finals[scorer.models.index(names[c])][k]
                equal = (final == final_of[c]) & (base[k] == base_of[c])
                ahead = (final > final_of[c]) | ((final == final_of[c]) & (base[k] > base_of[c]))
                ranks[c] += int(ahead.sum()) + int(equal[: bisect_left(cat.order, keys[c])].sum())
    asked["rank"] = ranks
    return asked if top is None else asked[asked["rank"] <= top]


def score_patterns(
    queries: DataFrame,
    catalogue: DataFrame,
    key: str = "cve_id",
    vector: str = "vector",
    model: str = "vector",
    hits: str | None = None,
    top: int | None = None,
    wanted: str | None = None,
    flow_weight: int = 1,
    round_fields: bool = True,
    limit: int = BROADCAST_LIMIT,
    scores: bool = False,
) -> DataFrame:
    """(key, model, capec_id, final_score, rank) of every query.

    ``hits`` names an array<struct<capec_id, score>> column of keyword scores;
    it adds the rows of ``<model>_keyword``. ``top`` keeps the first ranks,
    ``wanted`` names an array column and keeps the patterns listed in it; both
    cut rows before they leave the task. ``scores`` adds what the final score is
    the mean of: ``fields`` and ``field_scores`` side by side, and
    ``execution_flow_score`` (null where it is none).
    """
    columns = [c for c in (key, vector, hits, wanted) if c]
    needed = queries.select(*columns).filter(F.col(vector).isNotNull())
    key_type = queries.schema[key].dataType.simpleString()
    entries = catalogue.select("capec_id", "kind", "slot", "vector")
    blocks = catalogue_blocks(entries, vector_bytes(F.col("vector")), "capec_id", limit, "vector")
    scorer = _Scorer(key, vector, model, hits, wanted, flow_weight, round_fields, scores)
    more = f", {SCORES}" if scores else ""
    names = [key, "model", "capec_id", "final_score", "rank", *(("fields", "field_scores", "execution_flow_score") if scores else ())]
    schema = f"{key} {key_type}, model string, capec_id string, final_score double, rank int{more}"

    if len(blocks) == 1 and hits:  # hits become objects for a piece of a batch only
        shape = to_arrow_schema(StructType.fromDDL(schema))

        def scored(batch: pa.RecordBatch, cat: Catalogue) -> pa.RecordBatch:
            rows = batch.to_pandas()
            return pa.RecordBatch.from_pandas(scorer.rows(rows, scorer.cells(rows, cat, top), names), shape, preserve_index=False)

        return map_blocks(needed, blocks, Catalogue, scored, schema, arrow=True)
    if len(blocks) == 1:
        return map_blocks(needed, blocks, Catalogue, lambda batch, cat: scorer.rows(batch, scorer.cells(batch, cat, top), names), schema)
    if top is not None or wanted:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded = Loaded(blocks, Catalogue)
            for batch in batches:
                found = wanted_over_blocks(batch, loaded, scorer, top) if wanted else best_over_blocks(batch, loaded, scorer, top)
                if found is not None and len(found):
                    yield scorer.rows(batch, found, names)

        return needed.mapInPandas(run, schema)
    every = [ROW, key, "model", "capec_id", "final", "base", *names[5:]]
    pairs = map_blocks(numbered(needed), blocks, Catalogue, lambda batch, cat: scorer.rows(batch, scorer.cells(batch, cat, None), every),
                       f"{ROW} long, {key} {key_type}, model string, capec_id string, final long, base long{more}")
    number = F.regexp_extract("capec_id", r"(\d+)$", 1).try_cast("long").asc_nulls_last()
    within = Window.partitionBy(ROW, "model").orderBy(F.desc("final"), F.desc("base"), number, "capec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(within)).withColumn("final_score", F.col("final") / 1000)
    return ranked.select(*names)


def without_vector(queries: DataFrame, key: str = "cve_id", vector: str = "vector") -> DataFrame:
    """(key, error) of the queries that can't be scored."""
    return queries.filter(F.col(vector).isNull()).select(key, F.lit("no vector").alias("error"))


def _hit_matrix(hits, patterns: list[str]) -> np.ndarray:
    """Keyword scores in thousandths; patterns without a hit get the malus."""
    place = {p: i for i, p in enumerate(patterns)}
    matrix = np.full((len(hits), len(patterns)), round(-1000 * lexicon.KEYWORD_MALUS), dtype=np.int64)
    for row, found in enumerate(hits):
        for hit in found if found is not None else ():
            column = place.get(hit["capec_id"])
            if column is not None:
                matrix[row, column] = round(hit["score"] * 1000)
    return matrix


def rank_patterns(scores: DataFrame, group: list[str], tie: str | None = None) -> DataFrame:
    """``rank`` 1..n per group by final_score, ties by pattern number then id."""
    number = F.regexp_extract("capec_id", r"(\d+)$", 1).try_cast("long").asc_nulls_last()
    ties = [F.col(tie)] if tie else [number, F.col("capec_id")]
    within = Window.partitionBy(*group).orderBy(F.col("final_score").desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(within))


def fuse_keyword(ranked: DataFrame, keyword: DataFrame, key: list[str], missing: float = 0.0) -> DataFrame:
    """Add ``<model>_keyword`` rows: base score plus keyword score, re-ranked.

    A pattern without keyword score counts as ``missing``; ties keep the base rank.
    """
    joined = ranked.join(keyword.select(*key, "capec_id", "keyword_score"), [*key, "capec_id"], "left")
    boosted = joined.select(
        *key,
        F.concat("model", F.lit("_keyword")).alias("model"),
        "capec_id",
        F.round(F.col("final_score") + F.coalesce("keyword_score", F.lit(missing)), 3).alias("final_score"),
        F.col("rank").alias("_base"),
    )
    again = rank_patterns(boosted, [*key, "model"], "_base").drop("_base")
    return ranked.unionByName(again)


def field_scores(
    queries: DataFrame, catalogue: DataFrame, key: str = "cve_id", vector: str = "vector", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """(key, capec_id, slot, score) of every field, rounded to thousandths."""
    key_type = queries.schema[key].dataType.simpleString()

    def rows(batch: pd.DataFrame, cat: Catalogue) -> pd.DataFrame:
        if cat.field_units is None:
            return pd.DataFrame()
        scores = half_up(_units(batch[vector]) @ cat.field_units.T * 1000) / 1000
        n, m = scores.shape
        return pd.DataFrame({
            key: np.repeat(batch[key].to_numpy(), m),
            "capec_id": np.tile(cat.fields["capec_id"].to_numpy(), n),
            "field": np.tile(cat.fields["slot"].to_numpy(), n),
            "score": scores.ravel(),
        })

    fields = catalogue.filter((F.col("kind") == "field") & F.col("vector").isNotNull()).select("capec_id", "kind", "slot", "vector")
    blocks = catalogue_blocks(fields, vector_bytes(F.col("vector")), "capec_id", limit)
    asked = queries.select(key, vector).filter(F.col(vector).isNotNull())
    return map_blocks(asked, blocks, Catalogue, rows, f"{key} {key_type}, capec_id string, field string, score double")


def flow_scores(step_scores: DataFrame, keys: list[str], step: str, score: str, parts: int = 2) -> DataFrame:
    """Mean over steps of the better part score; a missing part counts as zero."""
    best = F.max(score)
    best = F.when(F.count(score) < parts, F.greatest(best, F.lit(0.0))).otherwise(best)
    steps = step_scores.groupBy(*keys, step).agg(best.alias("_best"))
    return steps.groupBy(*keys).agg(F.avg("_best").alias("flow_score"))


def final_scores(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean of all present scores, each exact to a thousandth."""
    thousandths = F.sum(F.round(F.col(score) * 1000).cast("long"))
    return scores.groupBy(*keys).agg((F.round(thousandths / F.count(score)) / 1000).alias("final_score"))


def model_list(models: list[str]) -> list[str]:
    """Models of a finished task: each one and its keyword variant, once."""
    return list(dict.fromkeys([*models, *[f"{m}_keyword" for m in models]]))
