"""Word shingles of whole texts as 64-bit hashes, for many texts at a time.

Works on the bytes of an Arrow string column: words are found with a byte class
table, each distinct word is hashed once by a keyed digest of its bytes, and
neighbours are mixed to shingles, in a fixed number of passes whatever the words are.
So no choice of words makes two different shingles meet but by the chance of 64 bits.
Texts are taken in groups of about half a megabyte, so memory stays bounded for any
batch; one very long text is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corrspark.llm.tokens import runs

GROUP_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES * 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Hashes of all words of a group of texts, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray  # one more than there are texts


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8, key=b"words of shingles").digest(), "little")


def hash_words(data: np.ndarray, offsets: np.ndarray, drop_punctuation: bool = False) -> Words:
    """Words of texts that lie one behind the other; A-Z are lower-cased."""
    if drop_punctuation:
        keep = ~_PUNCTUATION[data]
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        data = data[keep]
    found = runs(data, offsets, ~_SPACE)
    hashes = np.fromiter(map(word_hash, found.terms.cast(pa.large_binary()).to_pylist()), np.uint64, len(found.terms))
    return Words(hashes[found.codes], np.searchsorted(found.start, offsets))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    Fewer words make one shingle of the whole sequence, no words none.
    """
    w, starts = words
    rolled = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix64((rolled + w[k:k + len(rolled)]) * np.uint64(_BASE))
    rolled = mix64(rolled + np.uint64(width))
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a:b - width + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = mix64((short + w[k:k + 1]) * np.uint64(_BASE))
            sets.append(mix64(short + np.uint64(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def groups(texts: pa.Array | pa.ChunkedArray, size: int = GROUP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a column into groups of texts: rows, their bytes, and offsets into them. Null is empty."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, len(column))
        yield slice(a, b), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b
