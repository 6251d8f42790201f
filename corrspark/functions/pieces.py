"""Arrow batches taken in pieces, so that a task's memory follows a bound and not the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and words of lists, that a task holds as Python objects at a time.
PIECE_BYTES, PIECE_WORDS = 2 << 20, 1 << 15


def pieces(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs whose bytes (of strings) or elements (of lists) fit; a larger row stands alone."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        most, sizes = most or PIECE_WORDS, pc.list_value_length(column)
    else:
        most, sizes = most or PIECE_BYTES, pc.binary_length(column)
    # an empty row counts too: very many of them are still a piece of their own
    ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(float)) + 16)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start = stop


def map_pieces(column: pa.Array, rule, out: pa.DataType) -> pa.Array:
    """A function of every value that is not null."""
    done = [
        pa.array([None if x is None else rule(x) for x in column.slice(start, size).to_pylist()], out) for start, size in pieces(column)
    ]
    return pa.concat_arrays(done) if done else pa.array([], out)
