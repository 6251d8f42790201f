"""LM scoring by subword lattice likelihood (operator 4).

The score of a text is the log probability of all its segmentations into pieces of
an existing vocabulary, summed by a forward recursion in log space. Pieces never
cross words, so a text's sum is the sum over its words, and the recursion runs once
per distinct word of the corpus.

Weights: the vocabulary file's own scores. A file of merge ranks (whole negative
numbers) has no probabilities; rank r then weighs 1 / (r + 2.7). From these, one
round of expectation over the lattices of all training words, weighted by their
counts, gives the learned weights; pieces the corpus lacks keep a smoothed share of
the old ones. A word ends before the next or before the end of the text; the end has
its own probability, learned from the training texts.

Work per text: frequent words (at most ``FREQUENT``, a bound in the driver and in
every task) are looked up in the task; the others meet their word's row in a join.
No word is left out, and no frequent word is a join key.

Edge cases: a null text is empty and has the end only; characters outside the
vocabulary fall back to byte pieces; rows that share an id and text get equal rows;
rows without an id are training rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.session import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT, SMOOTH = 100_000, 0.5
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece to log weight, normalised; byte pieces are named ``<0xNN>``."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if "▁" not in model.id_to_piece(i)[1:]}
    plain = [s for p, s in scores.items() if not _is_byte(p)]
    if all(s <= 0 and s == int(s) for s in plain):
        order = sorted((p for p in scores if not _is_byte(p)), key=lambda p: (-scores[p], p))
        weights = {p: -math.log(r + 2.7) for r, p in enumerate(order)}
        low = min(weights.values())
        weights |= {p: low for p in scores if _is_byte(p)}
    else:
        weights = scores
    total = math.log(math.fsum(math.exp(w) for w in weights.values()))
    return {p: w - total for p, w in weights.items()}


def _is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x")


class Lattice:
    """Segmentations of words over a weighted vocabulary."""

    def __init__(self, weights: dict[str, float]) -> None:
        import ahocorasick

        self.names = sorted(weights)
        self.weights = [weights[p] for p in self.names]
        place = {p: i for i, p in enumerate(self.names)}
        self.single = {p for p in self.names if len(p) == 1}
        self.bytes = [place.get(f"<0x{b:02X}>") for b in range(256)]
        self.find = ahocorasick.Automaton()
        for p, i in place.items():
            if not _is_byte(p):
                self.find.add_word(p, (len(p) - 1, self.weights[i], (i,)))
        self.find.make_automaton()

    def arcs(self, word: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, log weight, pieces) in order of their ends."""
        text = "▁" + word
        arcs = [(end - n, end + 1, w, i) for end, (n, w, i) in self.find.iter(text)]
        missing = [k for k, c in enumerate(text) if c not in self.single]
        if missing:
            for k in missing:
                spelled = tuple(self.bytes[b] for b in text[k].encode("utf-8", "replace"))
                arcs.append((k, k + 1, sum(self.weights[i] for i in spelled), spelled))
            arcs.sort(key=lambda a: a[1])
        return arcs

    def forward(self, arcs: list, n: int) -> list[float]:
        nothing, exp, log1p = -math.inf, math.exp, math.log1p
        alpha = [nothing] * (n + 1)
        alpha[0] = 0.0
        for start, end, weight, _ in arcs:
            new, old = alpha[start] + weight, alpha[end]
            if old == nothing:
                alpha[end] = new
            elif old > new:
                alpha[end] = old + log1p(exp(new - old))
            else:
                alpha[end] = new + log1p(exp(old - new))
        return alpha

    def log_probability(self, word: str) -> float:
        return self.forward(self.arcs(word), len(word) + 1)[-1]

    def expect(self, word: str, count: float, out: list[float]) -> None:
        """Add ``count`` times the expected use of every piece in the word's segmentations."""
        arcs, n = self.arcs(word), len(word) + 1
        # most words are short enough for plain products; the others go on in log space
        alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        exp = math.exp
        steps = [(start, end, exp(weight), pieces) for start, end, weight, pieces in arcs]
        for start, end, weight, _ in steps:
            alpha[end] += alpha[start] * weight
        if alpha[n] > 1e-200:
            part = count / alpha[n]
            for start, end, weight, pieces in reversed(steps):
                rest = beta[end] * weight
                posterior = alpha[start] * rest * part
                for i in pieces:
                    out[i] += posterior
                beta[start] += rest
            return
        alpha = self.forward(arcs, n)
        beta = [-math.inf] * n + [0.0]
        for start, end, weight, pieces in reversed(arcs):
            new, old = beta[end] + weight, beta[start]
            if new > -math.inf:
                posterior = count * math.exp(alpha[start] + new - alpha[n])
                for i in pieces:
                    out[i] += posterior
                beta[start] = new if old == -math.inf else max(old, new) + math.log1p(math.exp(-abs(old - new)))


@lru_cache(maxsize=2)
def _lattice(items: tuple[tuple[str, float], ...]) -> Lattice:
    return Lattice(dict(items))


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes split at just the white space that separates words."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned, other = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(learned.keys() | other.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64()), pa.array([learned[w] + other[w] for w in words], pa.int64())],
            names=["word", "c", "n"])

    for batch in batches:
        for out_of_training, text in zip(batch.column(0), batch.column(1), strict=True):
            (other if out_of_training.as_py() else learned).update(tokens(text.as_py()))
            if len(learned) + len(other) > HELD_WORDS:
                yield out()
                learned, other = Counter(), Counter()
    if learned or other:
        yield out()


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared.value)
        total = [0.0] * len(lattice.names)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(word.decode("utf-8", "replace"), c, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.array(total)[used])], names=["piece", "expected"])

    return run


def train(words: DataFrame, weights: dict[str, float], smooth: float = SMOOTH) -> dict[str, float]:
    """Weights after one round of expectation over the training words' lattices."""
    items = tuple(sorted(weights.items()))
    shared = words.sparkSession.sparkContext.broadcast(items)
    rows = words.where("c > 0").select("word", "c").mapInArrow(_expected(shared), "piece int, expected double")
    expected = dict(rows.groupBy("piece").agg(F.sum("expected")).toLocalIterator())  # one row per piece at most
    mass = smooth * len(items)
    total = math.fsum(expected.values()) + mass
    return {p: math.log((expected.get(i, 0.0) + mass * math.exp(w)) / total) for i, (p, w) in enumerate(items)}


def _word_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared.value)
        for batch in batches:
            scores = [lattice.log_probability(w.decode("utf-8", "replace")) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.float64())], names=["word", "c", "n", "lattice"])

    return run


def _partial(shared):
    """Per text a row without a word (what is known in the task), and a row for every other distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, end_known, end_base = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, print_of, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                key = doc_id.as_py(), print_of.as_py()
                counts = Counter(tokens(text.as_py()))
                n, known, base, score = 1, end_known, end_base, 0.0
                for word, k in counts.items():
                    n += k
                    found = frequent.get(word)
                    if found is None:
                        rows.append((*key, word, k, 0, 0.0, 0.0))
                    else:
                        known += k * found[0]
                        base += k * found[1]
                        score += k * found[2]
                rows.append((*key, None, n, known, base, score))
                if len(rows) > 100_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return run


_PARTIAL = "doc_id long, print long, word binary, n long, known long, base double, lattice double"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in _PARTIAL.split(", ")])


def score(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("out"), "text")
    counts = materialise(rows.select("out", "text").mapInArrow(_count_words, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = rows.where(~F.col("out")).count()
    known = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = known[0] + ends, known[1] + (ends > 0)
    weights = train(counts, read_vocabulary(vocabulary))
    shared = spark.sparkContext.broadcast(tuple(sorted(weights.items())))

    below = total + 0.5 * (distinct + 1)
    go_on, stop = math.log10((total - ends + 0.5) / (total + 1)), math.log10((ends + 0.5) / (total + 1))
    scored = materialise(
        counts.mapInArrow(_word_scores(shared), "word binary, c long, n long, lattice double")
        .select("word", "c", "n", F.log10((F.col("c") + 0.5) / below).alias("base"), (F.col("lattice") + go_on).alias("lattice")), "word-scores")
    top = scored.orderBy(F.desc("n"), "word").limit(frequent)
    looked_up = {r["word"]: (int(r["c"] > 0), r["base"], r["lattice"]) for r in top.toLocalIterator()}
    ready = spark.sparkContext.broadcast(({bytes(w): v for w, v in looked_up.items()}, int(ends > 0), math.log10((ends + 0.5) / below)))

    prints = rows.select("doc_id", F.xxhash64("text").alias("print"), "text")
    partial = materialise(prints.mapInArrow(_partial(ready), _PARTIAL), "partial")
    rare = partial.where("word is not null").join(scored.select("word", "c", F.col("base").alias("b"), F.col("lattice").alias("l")), "word").select(
        "doc_id", "print", F.lit(0).alias("texts"), F.lit(0).alias("n"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.col("b")).alias("base"), (F.col("n") * F.col("l")).alias("lattice"))
    whole = partial.where("word is null").select("doc_id", "print", F.lit(1).alias("texts"), "n", "known", "base", "lattice")
    sums = whole.unionByName(rare).groupBy("doc_id", "print").agg(*(F.sum(c).alias(c) for c in ("texts", "n", "known", "base", "lattice")))
    # rows that share id and text were summed together; each gets its part
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("texts"))))
    return each.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.expr("n div texts").alias("n_tokens"), F.expr("known div texts").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("texts")).alias("base_score"), (F.col("lattice") / F.col("texts") + stop).alias("score"),
    )
