"""Chat formatting by prefix-target expansion (operator 3).

Every assistant turn is an example of its own: all preceding turns of the
conversation are its context, and only its reply is trainable. :func:`expand` makes
the examples as rows of turns, so an example is never held as one text: a turn goes
into the example of its own reply and into all later ones, and only the target's row
has a loss span. Examples of one conversation grow with the square of its length;
they are dealt out by example, so that a long conversation is spread over all tasks.
:func:`read_examples` reads every example back as a stream, :func:`digest` sums the
readings up per conversation, and :func:`written_out` gives full texts.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline.
Inside roles and texts one backslash is put behind the ``<`` of every
``<|``, ``<\\|``, ``<\\\\|`` ..., so no control string can appear there, and
taking one backslash away gives the text back. See :func:`escape_role` for line
breaks in roles.

Edge cases: a null text is empty, a null role is the empty role; null turns come
first; turns with one number are ordered by role, then text; repeated rows are
turns of their own; turns behind the last reply stay as context without a target;
a conversation may be null (one conversation). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, TARGET_ROLE = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    """Roles stand before the first line break: a break is ``%0A``, a percent sign ``%25``."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One formatted row per turn: ``conv_id, turn, role, segment, loss_start, loss_end``.

    ``loss_start`` and ``loss_end`` count code points of the segment; they are null
    where the turn is no target. The reply's end mark is not in the span.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    return (
        conversations.select(F.col("conv_id"), F.col("turn"), role.alias("role"), head.alias("_head"), escape(text).alias("_body"))
        .select(
            "conv_id", "turn", "role",
            F.concat("_head", "_body", F.lit(END + "\n")).alias("segment"),
            F.when(F.col("role") == TARGET_ROLE, F.length("_head")).alias("loss_start"),
            F.when(F.col("role") == TARGET_ROLE, F.length("_head") + F.length("_body")).alias("loss_end"),
        )
    )


def written_out(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Full examples ``conv_id, turn, example, loss_start, loss_end``: text and its one span.

    The output is as large as the sum of all prefixes; give ``conv_ids`` to write
    out some conversations only.
    """
    rows = turns if conv_ids is None else turns.join(conv_ids, "conv_id", "left_semi")
    order = Window.partitionBy("conv_id").orderBy(*_ORDER)
    prefix = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.concat_ws("", F.collect_list("segment").over(prefix)))
        .where(F.col("loss_start").isNotNull())
        .select("conv_id", "turn", F.concat("_before", "segment").alias("example"), *((F.length("_before") + F.col(c)).alias(c) for c in ("loss_start", "loss_end")))
    )


_ORDER = ("turn", "role", "segment")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(segment)
    if found is None:
        raise ValueError("not a formatted turn")
    return unescape_role(found[1]), unescape(found[2])


def expand(turns: DataFrame) -> DataFrame:
    """Examples as rows of turns: ``conv_id, example, place, segment, loss_start, loss_end``.

    Examples of a conversation count from 0 by their targets. Turns behind the last
    reply give one more example, of the whole conversation and without a loss span;
    it is there so that all turns can be read back.
    """
    whole, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(*_ORDER)
    target = F.col("loss_start").isNotNull()
    before = F.coalesce(F.sum(target.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.col("_first") == F.col("example")
    return (
        turns.select("conv_id", "segment", "loss_start", "loss_end", F.row_number().over(order).alias("place"), before.alias("_first"))
        .withColumn("_last", F.max("_first").over(whole))
        .withColumn("example", F.explode(F.sequence("_first", "_last")))
        .select("conv_id", "example", "place", "segment", *(F.when(own, F.col(c)).alias(c) for c in ("loss_start", "loss_end")))
    )


class _Example:
    """Reading of one example; holds no text but the reply."""

    def __init__(self) -> None:
        self.turns, self.n_turns, self.chars, self.reply = hashlib.sha256(), 0, 0, None

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        role, text = read_turn(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.chars += len(segment)
        if start is not None:
            self.reply = unescape(segment[start:end])

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.chars, self.reply


class _Conversation:
    """Sums over the readings of one conversation, in the order of its examples."""

    def __init__(self) -> None:
        self.loss, self.loss_chars, self.formatted, self.n_examples = hashlib.sha256(), 0, 0, 0

    def add(self, n_turns: int, turns_sha256: str, chars: int, reply: str | None) -> None:
        self.n_turns, self.turns_sha256, self.stored = n_turns, turns_sha256, chars  # the last example has all turns
        if reply is not None:
            self.loss.update(reply.encode())
            self.loss_chars += len(reply)
            self.formatted += chars
            self.n_examples += 1

    def row(self) -> tuple:
        return self.n_turns, self.turns_sha256, self.loss_chars, self.loss.hexdigest(), self.formatted, self.n_examples, self.stored


_READING = "conv_id long, example int, n_turns long, turns_sha256 string, chars long, reply string"
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, stored_chars long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
#: Rows and characters of replies after which a batch is handed on.
_BATCH_ROWS, _BATCH_CHARS = 4096, 1 << 22


def _grouped(keys: int, reader: type, schema: str):
    """Map over sorted rows: the first ``keys`` columns are a group's key, the others go to its reader."""
    columns = [part.split() for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, rows, held = None, None, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:keys] != current:
                    if state is not None:
                        rows.append((*current, *state.row()))
                        held += len(rows[-1][-1] or "") if columns[-1][1] == "string" else 0
                    current, state = row[:keys], reader()
                state.add(*row[keys:])
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_CHARS:
                    yield _batch(rows, columns)
                    rows, held = [], 0
        if state is not None:
            rows.append((*current, *state.row()))
        if rows:
            yield _batch(rows, columns)

    return run


def _batch(rows: list[tuple], columns: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True)], names=[name for name, _ in columns])


def read_examples(examples: DataFrame) -> DataFrame:
    """One row per example, read back turn by turn: counts, hash of its turns, and the reply under its loss span."""
    ordered = examples.repartition("conv_id", "example").sortWithinPartitions("conv_id", "example", "place")
    return ordered.select("conv_id", "example", "segment", "loss_start", "loss_end").mapInArrow(_grouped(2, _Example, _READING), _READING)


def digest(turns: DataFrame) -> DataFrame:
    """Expand the formatted turns, read all examples back: counts and hashes per conversation.

    Readings of a conversation pass one task in order, as a running hash of its
    replies needs, but are never held together. ``formatted_chars`` is the length of
    all its examples; ``stored_chars`` that of the conversation.
    """
    readings = read_examples(expand(turns)).repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return readings.select("conv_id", "n_turns", "turns_sha256", "chars", "reply").mapInArrow(_grouped(1, _Conversation, _DIGEST), _DIGEST)


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
s AS (SELECT *, length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A'))
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS n FROM t),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples, CAST(sum(n) AS BIGINT) AS stored_chars
FROM r GROUP BY conv_id
"""
