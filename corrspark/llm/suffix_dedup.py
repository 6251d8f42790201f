"""Removal of repeated substrings with a sampled, distributed suffix array (operator 1).

A byte goes where a ``LENGTH``-byte string covers it that also starts earlier.

Sampling. In every window of ``LENGTH`` bytes the ``ANCHOR``-byte string with the
smallest hash is its anchor; equal windows have equal anchors at equal places.
Neighbouring windows mostly share their anchor, so a text is a list of runs: an
anchor, and the windows around it. Only runs travel, as fingerprints.

Pre-aggregation. A run that is equal to an earlier one is removed as a whole; first
inside a task (so that no run, however common, is sent more than once by a task),
then among all.

Sorting. What is left are anchors with several different surroundings. Their
suffixes, to the right and, reversed, to the left, are ordered by deep-shallow
sorting: multikey quicksort, on eight bytes at a time, to ``SHALLOW`` bytes, then a
blind trie for every group that is still equal. Two windows at the same place around
an anchor are equal just if the common prefixes on both sides are long enough, so
classes of equal windows are intervals of the two orders; all but the first member
of a class are removed. Anchors with more than ``GROUP_ROWS`` surroundings do not fit
one task; their windows are compared by 128-bit digests in a grouped minimum.

Runs are compared by two 64-bit fingerprints, surroundings by their bytes.

Edge cases: null and short texts have nothing to remove; a null id comes before all
ids; rows that share an id are documents of their own in the order of their text's
digest, and rows equal in both are one document, all with its result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrspark.llm.shingles import _LETTER, _power_tables, groups, mix64
from corrspark.session import materialise

LENGTH, ANCHOR, SHALLOW, GROUP_ROWS = 100, 32, 40, 100_000
#: Runs that a task holds before it hands them on.
HELD_RUNS = 1_000_000
#: Longest piece of a text whose windows are searched at once; pieces overlap.
PIECE = 1 << 23

_PLACE_BITS = 24
#: A run's place as one number that sorts like (copy, anchor): anchor's offset, first and last window as distances before it.
_OFF, _AT, _COPY = 7, 14, 46


def pack(copy: np.ndarray, anchor: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (copy << _COPY) | (anchor << _AT) | (before << _OFF) | after


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _OFF) - 1
    return packed >> _COPY, (packed >> _AT) & ((1 << (_COPY - _AT)) - 1), (packed >> _OFF) & low, packed & low


def find_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of texts that lie one behind the other: anchor hash, fingerprint, first, last, anchor (places in ``data``)."""
    n, windows = len(data), LENGTH - ANCHOR + 1
    empty = np.empty(0, np.int64)
    if n < LENGTH:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[:n - ANCHOR + 1])
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least, width = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), 1
    while width * 2 <= windows:  # minima of windows of twice the width
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < windows:
        least = np.minimum(least[:len(least) - (windows - width)], least[windows - width:])
    anchor_of = (least & mask).astype(np.int64)
    crosses = np.zeros(n + 2, np.int32)  # windows that reach into the next text
    ends = offsets[1:]
    crosses[:] = np.bincount(np.maximum(offsets[:-1], ends - LENGTH + 1), minlength=n + 2) - np.bincount(ends, minlength=n + 2)
    start = np.flatnonzero(np.cumsum(crosses)[:len(anchor_of)] == 0)
    if not len(start):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    anchor = anchor_of[start]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last, anchor = start[new], start[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))], anchor[new]
    shape = ((anchor - first) << 8 | (anchor - last)).astype(np.uint64)
    prints = mix64(mix64((sums[last + LENGTH] - sums[first]) * inverse[first]) + shape * np.uint64(0x9E3779B97F4A7C15))
    return hashes[anchor], prints, first, last, anchor


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Cut a group that is one very long text into overlapping pieces: first text, bytes, offsets, place of the piece."""
    if len(data) <= PIECE:
        yield 0, data, offsets, 0
        return
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for at in range(a, max(a + 1, b - LENGTH + 1), PIECE - LENGTH + 1):
            part = data[at:min(b, at + PIECE)]
            yield k, part, np.array([0, len(part)]), at - a


_RUNS = "h long, f long, doc long, packed long"


def _run_batch(h, f, doc, packed, mask=None) -> pa.RecordBatch:
    """Rows of runs; a row without ``h`` is a removed span: ``f`` its start, ``packed`` copy and end."""
    names = [p.split()[0] for p in _RUNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64(), mask=mask), pa.array(f, pa.int64()), pa.array(doc, pa.int64()), pa.array(packed, pa.int64())], names=names)


def merge_spans(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join spans that overlap or touch; needs no order."""
    order = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[order], copy[order], start[order], end[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
    text = np.cumsum(other)
    reach = np.maximum.accumulate(end + text * (1 << 40)) - text * (1 << 40)  # furthest end so far in the text
    new = other | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return doc[at], copy[at], start[at], reach[np.concatenate((at[1:] - 1, [len(start) - 1]))]


def _span_batch(doc, copy, start, end) -> pa.RecordBatch:
    doc, copy, start, end = merge_spans(doc, copy, start, end)
    return _run_batch(np.zeros(len(doc), np.int64), start, doc, (copy << _COPY) | end, np.ones(len(doc), bool))


def _reduced(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Send the first of equal runs; the others are removed here."""
    h, f, doc, packed = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(h ^ mix64(f.view(np.uint64)).view(np.int64))
    h, f, doc, packed = h[order], f[order], doc[order], packed[order]
    equal = np.concatenate(([False], (h[1:] == h[:-1]) & (f[1:] == f[:-1])))
    group = np.cumsum(~equal) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    low = several[np.lexsort((packed[several], doc[several], group[several]))]
    head = np.concatenate(([True], group[low][1:] != group[low][:-1])) if len(low) else np.empty(0, bool)
    ahead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(low) else low
    same = (doc[low] == doc[low[ahead]]) & (packed[low] == packed[low[ahead]])  # a repeated row is no copy
    gone = low[~same]
    send = np.ones(len(h), bool)
    send[low[~head]] = False
    yield _run_batch(h[send], f[send], doc[send], packed[send])
    if len(gone):
        copy, anchor, before, after = unpack(packed[gone])
        yield _span_batch(doc[gone], copy, anchor - before, anchor - after + LENGTH)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        for rows, data, offsets in groups(batch.column(2)):
            for k, part, cuts, at in _pieces(data, offsets):
                h, f, first, last, anchor = find_runs(part, cuts)
                if not len(h):
                    continue
                text = np.searchsorted(cuts, first, "right") - 1
                place = anchor - cuts[text] + at
                row = rows.start + k + text
                parts.append((h.view(np.int64), f.view(np.int64), ids[row], pack(copies[row], place, anchor - first, anchor - last)))
                held += len(h)
        if held >= HELD_RUNS:
            yield from _reduced(parts)
            parts, held = [], 0
    if held:
        yield from _reduced(parts)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in the order of (h, f, doc, packed): spans of repeated runs, and the first runs of anchors with several."""
    last_h = last_f = first_doc = first_packed = None  # the run at the head of the current group
    waiting = None  # the first run of the current anchor, until there is a second one
    for batch in batches:
        mask = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        spans = np.flatnonzero(mask)
        if len(spans):
            yield batch.take(pa.array(spans))
        rows = np.flatnonzero(~mask)
        if not len(rows):
            continue
        h, f, doc, packed = (batch.column(i).fill_null(0).to_numpy()[rows] for i in range(4))
        new_h = np.concatenate(([h[0] != last_h if last_h is not None else True], h[1:] != h[:-1]))
        new_f = new_h | np.concatenate(([f[0] != last_f], f[1:] != f[:-1]))
        head = np.maximum.accumulate(np.where(new_f, np.arange(len(h)), -1))
        carried = head < 0
        own = np.maximum(head, 0)
        head_doc = np.where(carried, first_doc if first_doc is not None else 0, doc[own])
        head_packed = np.where(carried, first_packed if first_packed is not None else 0, packed[own])
        gone = ~new_f & ((doc != head_doc) | (packed != head_packed))
        if gone.any():
            copy, anchor, before, after = unpack(packed[gone])
            yield _span_batch(doc[gone], copy, anchor - before, anchor - after + LENGTH)
        firsts = np.flatnonzero(new_f)
        out = []
        if len(firsts):
            starts = new_h[firsts]
            later = ~starts
            follows = np.concatenate((later[1:], [False]))
            if later[0] and waiting is not None:
                out.append(tuple(np.array([v]) for v in waiting))
            chosen = firsts[later | (starts & follows)]
            out.append((h[chosen], f[chosen], doc[chosen], packed[chosen]))
            end = firsts[-1]
            waiting = (h[end], f[end], doc[end], packed[end]) if starts[-1] else None
            out = [o for o in out if len(o[0])]
            if out:
                yield _run_batch(*(np.concatenate(c) for c in zip(*out, strict=True)))
        last_h, last_f, first_doc, first_packed = h[-1], f[-1], head_doc[-1], head_packed[-1]


class BlindTrie:
    """Strings by their branching bytes only; equal strings share a leaf."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # a leaf is a list of strings, a branch a (depth, children) pair

    def add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent to some leaf
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(k)
            return
        depth = common_prefix(s, other)
        holder, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            holder, key = node[1], s[node[0]]
            node = holder[key]
        mine = s[depth] if depth < len(s) else -1
        if isinstance(node, tuple) and node[0] == depth:
            node[1][mine] = [k]
            return
        split = (depth, {(other[depth] if depth < len(other) else -1): node, mine: [k]})
        if holder is None:
            self.root = split
        else:
            holder[key] = split

    def order(self) -> Iterator[int]:
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield from node


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    unlike = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (unlike.bit_length() + 7) // 8


def deep_shallow_sort(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings inside their groups, and common prefixes with the one before (-1 at the start of a group)."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings])
    width = -(-max(int(sizes.max()), shallow, 1) // 8) * 8
    table = np.zeros((n, width), np.uint8)
    inside = np.arange(width)[None, :] < sizes[:, None]
    table[inside] = np.frombuffer(b"".join(strings), np.uint8)
    words = table.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = group[order]
    at = np.arange(n)  # places whose order is open
    for k in range(shallow // 8):
        if not len(at):
            break
        key = words[order[at], k]
        by = np.lexsort((key, segment))
        order[at], segment, key = order[at[by]], segment[by], key[by]
        new = np.concatenate(([True], (segment[1:] != segment[:-1]) | (key[1:] != key[:-1])))
        segment = np.cumsum(new) - 1
        open_ = np.bincount(segment)[segment] > 1
        at, segment = at[open_], segment[open_]
    cuts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if len(at) else at
    for a, b in zip(cuts.tolist(), np.append(cuts, len(at))[1:].tolist(), strict=True):  # none if all differ early
        members = order[at[a:b]]
        trie = BlindTrie(strings)
        for k in members.tolist():
            trie.add(k)
        order[at[a:b]] = np.fromiter(trie.order(), np.int64, b - a)
    prefix = np.full(n, -1, np.int64)
    if n > 1:
        unlike = table[order[1:]] != table[order[:-1]]
        common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
        prefix[1:] = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, prefix


def repeated_windows(group: np.ndarray, rank: np.ndarray, before: np.ndarray, after: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Which windows of which row are no first ones: rows by distance of the window's start before the anchor.

    ``rank`` orders rows by document and place; ``left`` is reversed, both start at the anchor.
    """
    n, most = len(group), LENGTH - ANCHOR + 1
    right_order, right_prefix = deep_shallow_sort(right, group)
    left_order, left_prefix = deep_shallow_sort(left, group)
    gone = np.zeros((n, most), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    by_rank = np.argsort(rank, kind="stable")
    for o in range(most):
        rows = by_rank[(before[by_rank] >= o) & (after[by_rank] <= o)]
        if not len(rows):
            continue
        right_class[right_order] = np.cumsum(right_prefix < LENGTH - o)
        left_class[left_order] = np.cumsum(left_prefix < o)
        key = right_class[rows] * (n + 1) + left_class[rows]
        firsts = np.unique(key, return_index=True)[1]
        gone[rows, o] = True
        gone[rows[firsts], o] = False
    return gone


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by anchor: spans of windows that are no first ones."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        h, doc, packed = (table.column(i).to_numpy() for i in range(3))
        order = np.lexsort((packed, doc, h))
        other = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (packed[order][1:] != packed[order][:-1])
        once = order[np.concatenate(([True], other))]  # repeated rows bring the same runs
        h, doc, packed, table = h[once], doc[once], packed[once], table.take(pa.array(once))
        left, right = table.column(3).to_pylist(), table.column(4).to_pylist()
        copy, anchor, before, after = unpack(packed)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((anchor, copy, doc))] = np.arange(len(h))
        group = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
        gone = repeated_windows(group, rank, before, after, [s[::-1] for s in left], right)
        edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        _, far = np.nonzero(edge == -1)
        if not len(row):
            return None
        return _span_batch(doc[row], copy[row], anchor[row] - far + 1, anchor[row] - near + LENGTH)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # rows of the last anchor wait for more
            if cut:
                found = solve(table.slice(0, cut))
                if found is not None:
                    yield found
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        found = solve(pa.Table.from_batches(held).combine_chunks())
        if found is not None:
            yield found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors of each text."""
    for batch in batches:
        out: list[tuple] = []
        for doc, text, runs in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            data, doc_id = (text.as_py() or "").encode(), doc.as_py()
            hs, packs = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
            _, anchor, before, after = unpack(packs)
            for h, p, a, b, c in zip(hs.tolist(), packs.tolist(), anchor.tolist(), before.tolist(), after.tolist(), strict=True):
                out.append((h, doc_id, p, data[a - b:a], data[a:a - c + LENGTH]))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "doc", "packed", "left", "right"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of anchors with very many surroundings, by digest."""
    for batch in batches:
        out: list[tuple] = []
        for doc, p, left, right in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            copy, anchor, before, after = (int(v) for v in unpack(np.int64(p)))
            text = left + right
            for o in range(after, before + 1):
                key = hashlib.blake2b(text[before - o:before - o + LENGTH], digest_size=16).digest()
                out.append((key, doc, (copy << _COPY) | (anchor - o)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["window", "doc", "at"])


def _hot_spans(rows: DataFrame) -> DataFrame:
    windows = materialise(rows.mapInArrow(_windows, "window binary, doc long, at long"), "windows")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("first"))
    later = windows.join(firsts, "window").where(F.struct("doc", "at") != F.col("first"))
    return later.select(F.lit(None).cast("long").alias("h"), F.col("at").bitwiseAND((1 << _COPY) - 1).alias("f"), "doc", (F.col("at") + LENGTH).alias("packed"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            digest, at, removed, n = hashlib.sha256(), 0, 0, 0
            if spans.is_valid:
                start, end = spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy()
                zero = np.zeros(len(start), np.int64)
                for a, b in zip(*(v.tolist() for v in merge_spans(zero, zero, start, end)[2:]), strict=True):
                    digest.update(data[at:a])
                    at, removed, n = b, removed + b - a, n + 1
            digest.update(data[at:])
            out.append((len(data), removed, n, digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, copy, text``: a number per document that follows the ids, and 0.

    Where several texts share an id (or have none), every text gets a number of its
    own, by id and then by digest: the place in a sort over all tasks.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), "text")
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows.select("doc_id", "doc", F.lit(0).alias("copy"), "text")
    rows = rows.withColumn("_print", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    ranks = rows.select("doc", "_print").distinct().orderBy("doc", "_print").withColumn("_rank", F.monotonically_increasing_id())
    ranks = materialise(ranks, "ranks")
    return rows.join(ranks, ["doc", "_print"]).select("doc_id", F.col("_rank").alias("doc"), F.lit(0).alias("copy"), "text")


def _copy_of(packed: Column) -> Column:
    return F.shiftright(packed, _COPY).cast("int")


def repeated_spans(keyed: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc, copy, start, end`` of removed bytes; spans may overlap."""
    runs = keyed.select("doc", "copy", "text").mapInArrow(_sample, _RUNS)
    dealt = runs.repartition(F.coalesce("h", F.xxhash64("doc", "f"))).sortWithinPartitions("h", "f", "doc", "packed")
    settled = materialise(dealt.mapInArrow(_settle, _RUNS), "runs")
    several = settled.where(F.col("h").isNotNull())
    hot = several.groupBy("h").count().where(F.col("count") > group_rows).select("h")
    texts = keyed.select("doc_id", "doc", "copy", "text")
    by_text = several.groupBy("doc", _copy_of(F.col("packed")).alias("copy")).agg(F.collect_list(F.struct("h", "packed")).alias("runs"))
    around = texts.join(by_text, ["doc", "copy"]).select("doc", "text", "runs").mapInArrow(_cut, "h long, doc long, packed long, left binary, right binary")
    spans = settled.where(F.col("h").isNull())
    if hot.isEmpty():
        compared = around.repartition("h").sortWithinPartitions("h").mapInArrow(_compare, _RUNS)
    else:
        around = materialise(around, "surroundings")
        rest = around.join(hot, "h", "left_anti")
        compared = rest.repartition("h").sortWithinPartitions("h").mapInArrow(_compare, _RUNS).union(_hot_spans(around.join(hot, "h", "left_semi")))
    return spans.union(compared).select(
        "doc", _copy_of(F.col("packed")).alias("copy"), F.col("f").alias("start"), F.col("packed").bitwiseAND((1 << _COPY) - 1).alias("end"))


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, group_rows).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = keyed.select("doc_id", "doc", "copy", "text").join(spans, ["doc", "copy"], "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
