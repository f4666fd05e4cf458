"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z are lower-cased.
All positions of a block of documents are handled by numpy at once; a block is bounded
in bytes, a single long document is a block of its own and is never cut.  Words are hashed
in slices of ``SLICE`` bytes, whose sums are joined where a word spans two of them, so a
text of any length takes about eight bytes of memory a byte, plus 32 a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(SLICE + 1, base & (1 << 64) - 1, U64)
    steps[0] = 1
    return np.cumprod(steps, dtype=U64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes of each word, slice by slice of the block."""
    out = np.zeros(len(start), U64)
    for at in range(0, len(raw), SLICE):
        to = min(at + SLICE, len(raw))
        total = np.zeros(to - at + 1, U64)
        np.cumsum((raw[at:to].astype(U64) + U64(1)) * _UP[: to - at], out=total[1:])
        a, b = np.searchsorted(end, at, "right"), np.searchsorted(start, to, "left")
        if a == b:
            continue
        first, last = np.maximum(start[a:b], at) - at, np.minimum(end[a:b], to) - at
        part = (total[last] - total[first]) * _DOWN[first]
        if start[a] < at:  # the word began in an earlier slice
            part[:1] *= U64(pow(_BASE, int(at - start[a]), 1 << 64))
        out[a:b] += part
    return mix(out + (end - start).astype(U64))


@dataclass
class Words:
    """The words of a block of documents, in order."""

    raw: np.ndarray  # folded bytes of the block
    start: np.ndarray  # of each word
    end: np.ndarray
    bounds: np.ndarray  # words of document d: bounds[d] to bounds[d + 1]
    hash: np.ndarray  # 64 bits of each word


def words_of(column: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    """Split and hash the texts of one column, each byte replaced as ``fold`` says; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    raw = fold[raw]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(column) + 1, np.int64), np.zeros(0, U64))
    inside = ~space[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(raw, start, end, np.searchsorted(start, offsets), _word_hashes(raw, start, end))


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.array(pc.binary_length(column).fill_null(0), dtype=np.int64)
        part = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; run over one document's words only."""
    keys = mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE)) | U64(1)
    count = len(hashed) - n + 1
    out = np.zeros(max(count, 0), U64)
    for k in range(n if count > 0 else 0):
        out += hashed[k : k + count] * keys[k]
    return mix(out + U64(n))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
