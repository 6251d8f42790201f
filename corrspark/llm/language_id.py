"""Language identification by cross-parsing entropy (operator 7).

A suffix automaton per language accepts every substring of that language's labelled
text. A text is parsed greedily into the longest phrases that occur there; a text in
the language needs few, long phrases. A phrase costs the bits of a place in a labelled
text, a byte that the language lacks ``UNKNOWN_BITS`` more, and the least bits per byte
of the parsed text win. To choose the language, the place is one in the longest sample
of all, so that a language does not gain by a short sample; ``bits_per_byte`` and the
rejection take a place in the sample of the chosen language itself.

Every label is learned that has a row outside the held-out ones, each from a sample of
at most ``SAMPLE_BYTES``: labelled texts in a seeded order, short ones first, the last
one cut at the bound. Everything else covers all rows and whole texts. Automata of up to
``BLOCK_BYTES`` are one block, and documents are mapped over it in place, without a
shuffle. More languages make more blocks: the documents are written once, mapped over
one block after the other, and every row keeps its least cost. The driver holds all
samples, but the automata of one block only.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; equal
costs go to the first language by name; without labelled texts all is ``und``; rows
without an id are not learned from and not held out; repeated rows are predicted one
by one; extra columns are kept by :func:`keep_known` and not read otherwise.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrspark.llm.common import fresh, seeded
from corrspark.session import materialise

#: Bytes learned of each language; texts of up to so many bytes come first.
SAMPLE_BYTES, SHORT_BYTES = 40_000, 3_000
#: Transition tables that a task holds at a time.
BLOCK_BYTES = 128 << 20
#: A byte that a language lacks, written out.
UNKNOWN_BITS = 8.0
#: Above so many bits per byte the labelled text does not help: the text is in no learned language.
REJECT_BITS = 8.0

_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased letters in UTF-8; runs of anything else in ASCII are one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Automaton(NamedTuple):
    """Transitions of a suffix automaton, state * symbols + symbol; 0 is no transition."""

    name: str
    steps: array
    length: int
    known: bytes  # symbols of the labelled text


def suffix_automaton(data: bytes, symbols: int) -> array:
    """Transition table over symbols 0 to ``symbols`` - 1; states are premultiplied."""
    following: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in data:
        state = len(following)
        following.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at != -1 and c not in following[at]:
            following[at][c] = state
            at = link[at]
        if at != -1:
            target = following[at][c]
            if longest[at] + 1 == longest[target]:
                link[state] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at != -1 and following[at].get(c) == target:
                    following[at][c] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    unknown = len(following)  # reached by absent symbols from the root only, and left by no symbol: a phrase of its own
    for c in range(symbols):
        following[0].setdefault(c, unknown)
    following.append({})
    table = array("i", bytes(4 * symbols * len(following)))
    for state, steps in enumerate(following):
        for c, to in steps.items():
            table[state * symbols + c] = to * symbols
    return table


def phrases(data: bytes, steps: array) -> int:
    """Number of greedy longest phrases; a symbol that never occurs is a phrase."""
    state, n = 0, 1
    for c in data:
        state = steps[state + c]
        if not state:
            n += 1
            state = steps[c]
    return n


class Found(NamedTuple):
    """The best language of a text: costs to choose by (least and second), and its own bits per byte."""

    lang: str = "und"
    cost: float = math.inf
    second: float = math.inf
    bits: float = math.inf


class Model(NamedTuple):
    alphabet: bytes  # symbol of every byte; 0: not in the labelled text
    automata: list[Automaton]
    longest: int  # bytes of the longest sample, also of other models of the same languages

    def costs(self, text: str) -> list[tuple[float, float]]:
        """For every language, bits per byte by the longest sample and by its own."""
        data = normal(text).translate(self.alphabet)
        size, common, out = max(1, len(data)), math.log2(self.longest + 1), []
        for a in self.automata:
            n, unknown = phrases(data, a.steps), UNKNOWN_BITS * len(data.translate(None, a.known))
            out.append(((n * common + unknown) / size, (n * math.log2(a.length + 1) + unknown) / size))
        return out

    def best(self, text: str | None) -> Found:
        if not self.automata or not has_letter(text):
            return Found()
        costs = self.costs(text)
        at = min(range(len(costs)), key=lambda i: costs[i][0])
        second = min((c for i, (c, _) in enumerate(costs) if i != at), default=math.inf)
        return Found(self.automata[at].name, costs[at][0], second, costs[at][1])


def build(samples: dict[str, str | bytes], longest: int = 0) -> Model:
    """A model from one labelled text (or its normal form) per language."""
    data = {name: text if isinstance(text, bytes) else normal(text) for name, text in sorted(samples.items())}
    used = sorted(set(b"".join(data.values())))
    alphabet = bytearray(256)
    for symbol, byte in enumerate(used, 1):
        alphabet[byte] = min(symbol, 255)
    coded = {n: d.translate(alphabet) for n, d in data.items() if d}
    automata = [Automaton(n, suffix_automaton(d, len(used) + 1), len(d), bytes(set(d))) for n, d in coded.items()]
    return Model(bytes(alphabet), automata, max([longest, *map(len, coded.values())]))


class Samples(NamedTuple):
    """Normal forms of the labelled texts, by language."""

    texts: dict[str, bytes]
    block_bytes: int

    def blocks(self) -> list[list[str]]:
        """Names of the languages of every block, by the most that their tables can take; one block at least."""
        out: list[list[str]] = [[]]
        used, size = set(), 0
        for name, data in sorted(self.texts.items()):
            wider, longer = used | set(data), size + len(data)
            if out[-1] and 8 * longer * (len(wider) + 1) > self.block_bytes:  # two states a byte, four bytes a step
                out.append([])
                wider, longer = set(data), len(data)
            out[-1].append(name)
            used, size = wider, longer
        return out

    def model(self, names: list[str]) -> Model:
        return build({n: self.texts[n] for n in names}, max(map(len, self.texts.values()), default=0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, block_bytes: int = BLOCK_BYTES) -> Samples:
    """A bounded sample of every language, from the labelled rows that are not held out."""
    learned = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.regexp_like(F.col("text"), F.lit(r"\p{L}"))
    )
    size = F.octet_length("text")
    short = F.when(size <= SHORT_BYTES, size)
    # rows of a language that hold the bytes: twice as many short ones as their mean asks for, then long ones
    rows = F.least(F.count(short), F.ceil(2 * sample_bytes / F.avg(short)))
    most = learned.groupBy("lang").agg(F.coalesce(rows, F.lit(0)).alias("rows")).agg(F.max("rows")).first()[0]
    limit = (most or 0) + sample_bytes // SHORT_BYTES + 1
    order = Window.partitionBy("lang").orderBy(size > SHORT_BYTES, seeded("language", F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        learned.select("doc_id", "lang", F.row_number().over(order).alias("_at"), (F.sum(size).over(order) - size).alias("_before"))
        .where(F.col("_at") <= limit).where(F.col("_before") < sample_bytes)
        .groupBy("doc_id", "lang").agg(F.min("_at").alias("_at"))
    )
    texts = (
        learned.select("doc_id", "lang", F.substring("text", 1, sample_bytes).alias("text"))
        .join(F.broadcast(rows), ["doc_id", "lang"]).orderBy("lang", "_at", "text")
    )
    samples: dict[str, bytes] = {}
    for row in texts.toLocalIterator():
        have = samples.get(row["lang"], b"")
        if len(have) < sample_bytes:
            samples[row["lang"]] = (have + b" " + normal(row["text"]))[:sample_bytes].strip()
    return Samples(samples, block_bytes)


_FOUND = "lang_pred string, cost double, second double, bits_per_byte double"


def _best(rows: DataFrame, model: Model) -> DataFrame:
    """Columns of ``rows`` but its last, the text, and what the model finds for it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), _FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = shared.value.best
        for batch in batches:
            found = [best(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([f[i] for f in found], pa.float64() if i else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lang_pred", "cost", "second", "bits_per_byte"])

    return rows.mapInArrow(run, schema)


def _best_of_blocks(rows: DataFrame, key: str, samples: Samples, blocks: list[list[str]]) -> DataFrame:
    """As :func:`_best`, over one block after the other; ``key`` numbers the rows and is the first column."""
    each = [materialise(_best(rows, samples.model(names)), "languages") for names in blocks]
    others = rows.columns[1:-1]
    costs = F.sort_array(F.flatten(F.collect_list(F.array("cost", "second"))))
    least = reduce(DataFrame.union, each).groupBy(key).agg(
        F.min(F.struct("cost", "lang_pred", "bits_per_byte", *others)).alias("_least"), costs[1].alias("second"))
    return least.select(key, *(F.col(f"_least.{c}").alias(c) for c in (*others, "lang_pred", "cost")), "second", F.col("_least.bits_per_byte").alias("bits_per_byte"))


def identify(docs: DataFrame, samples: Samples) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every row."""
    rows, blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"), samples.blocks()
    if len(blocks) == 1:
        found = _best(rows, samples.model(blocks[0]))
    else:
        rows = materialise(rows.select(F.monotonically_increasing_id().alias("_row"), "*"), "numbered")
        found = _best_of_blocks(rows, "_row", samples, blocks)
    score = F.when(F.col("cost") == math.inf, 0.0).when(F.col("second") == math.inf, 1.0).otherwise(1 - F.col("cost") / F.col("second"))
    return found.select("doc_id", "held_out", "lang_pred", score.alias("score"), "bits_per_byte")


def keep_known(docs: DataFrame, samples: Samples, reject_bits: float = REJECT_BITS) -> DataFrame:
    """Rows of ``docs`` whose text is in a learned language, with all their columns."""
    blocks = samples.blocks()
    if len(blocks) > 1:
        row = fresh(docs, "_row")
        rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        known = _best_of_blocks(rows.select(row, "text"), row, samples, blocks).where(F.col("bits_per_byte") < reject_bits).select(row)
        return rows.join(known, row, "left_semi").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(samples.model(blocks[0]))
    text = fresh(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = shared.value.best
        for batch in batches:
            keep = np.array([best(t.as_py()).bits < reject_bits for t in batch.column(batch.num_columns - 1)], bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    return docs.withColumn(text, F.col("text")).mapInArrow(run, docs.schema)
