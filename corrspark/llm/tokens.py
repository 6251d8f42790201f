"""Words of many texts as byte ranges and dictionary codes.

Works on the bytes of an Arrow string column with a byte class table, in a fixed
number of passes. Equal words get equal codes by comparing their bytes; no hash
stands for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Runs(NamedTuple):
    """Maximal runs of the wanted bytes: where they lie, and the dictionary of their lower-cased texts."""

    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    terms: pa.Array  # large_string, in order of first appearance


def byte_class(wanted: np.ndarray | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[wanted] = True
    return table


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Runs:
    """Runs of bytes of the class ``inside`` in texts that lie one behind the other; none crosses texts."""
    n = len(data)
    wanted = inside[data]
    first = wanted.copy()
    first[1:] &= ~wanted[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = wanted[cuts]
    last = wanted.copy()
    last[:-1] &= ~wanted[1:]
    last[cuts - 1] = wanted[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start)))
    texts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[data[wanted]])))
    coded = texts.dictionary_encode()
    return Runs(start, end, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Regroup batches into blocks of at most ``rows`` rows and, but for one longer text, ``size`` bytes.

    Yields the block's rows, the bytes of the column (null: empty), and the texts' offsets in them.
    """
    held: list[pa.RecordBatch] = []
    n_rows = n_bytes = 0

    def block() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        batch = whole.to_batches()[0]
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, offset_buffer, data_buffer = texts.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
        return batch, data[offsets[0]:offsets[-1]], offsets - offsets[0]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        a = 0
        while a < batch.num_rows:
            room = ends[a] + size - n_bytes
            b = min(int(np.searchsorted(ends, room, "right")) - 1, a + rows - n_rows, batch.num_rows)
            if b <= a:
                if held:
                    yield block()
                    held, n_rows, n_bytes = [], 0, 0
                    continue
                b = a + 1
            held.append(batch.slice(a, b - a))
            n_rows, n_bytes, a = n_rows + b - a, n_bytes + int(ends[b] - ends[a]), b
    if held:
        yield block()
