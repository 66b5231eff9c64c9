"""Words of many texts at once, as arrays.

An Arrow batch holds its texts in one byte buffer. The functions here find all
words of the buffer with array operations and give each word a 64-bit hash, so
that a task spends some nanoseconds on a byte and no Python loop runs per word.

A null text counts as an empty one. A text may be of any length: buffers are
hashed in pieces, so the working memory beside the text is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on, unless a single text is longer.
STEP = 4 << 20
PIECE = 1 << 16

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: All of ASCII but digits and lower-case letters; higher bytes belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Tables:
    """Random value of each byte, powers of the base and of its inverse."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240607).integers(1, _ALL, 256, dtype=np.uint64, endpoint=True)
        self.grow(PIECE + (1 << 16))

    def grow(self, n: int) -> None:
        self.up = _powers(_BASE, n)
        self.down = _powers(pow(_BASE, -1, 1 << 64), n)


_TABLES: list[_Tables] = []


def _tables(n: int) -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    if len(_TABLES[0].up) < n:
        _TABLES[0].grow(n)
    return _TABLES[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return codes, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        at = 0
        place = batch.schema.get_field_index(column)
        _, offsets = text_buffer(batch.column(place))
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Steps of about ``limit`` bytes of text, several batches put together if they are smaller."""
    held, size = [], 0
    for step in steps(batches, column, limit):
        _, offsets = text_buffer(step.column(column))
        if held and size + offsets[-1] > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(step)
        size += int(offsets[-1])
    if held:
        yield pa.concat_batches(held)


@dataclass
class Words:
    """Words of a batch in order: bytes ``start:end`` of ``codes`` belong to text ``doc``."""

    codes: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Word number at which each text begins, and their total."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)), "left")


def words_of(column: pa.Array, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes that are no separators; ``fold`` maps bytes first (letter case)."""
    codes, offsets = text_buffer(column)
    if fold is not KEEP_CASE:
        codes = fold[codes]
    inside = ~separators[codes]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(codes, offsets, start, end, doc, _hashes(codes, start, end))


def span_hash_bytes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start:end``, for spans in order that do not overlap; equal bytes, equal hash."""
    return _hashes(codes, start, end)


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        stop = max(int(np.searchsorted(end, low + PIECE, "right")), at + 1)
        t = _tables(int(end[stop - 1] - low) + 1)
        piece = codes[low : end[stop - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(t.values[piece] * t.up[: len(piece)], out=sums[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * t.down[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out)


def grams(words: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words of one text, and the number of its first word."""
    many = len(words.hash) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:many] == words.doc[n - 1 :])
    return run_hash(words.hash, many, n, seed)[at], at


def run_hash(values: np.ndarray, many: int, n: int, seed: int = 0) -> np.ndarray:
    """Hash of ``n`` numbers in order, at each of the first ``many`` places."""
    return chain([values[i : i + many] for i in range(n)], seed)


def chain(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Hash over the columns of ``parts`` in order."""
    total = np.full(len(parts[0]), np.uint64((seed * 0x632BE59BD9B4E019 + len(parts)) & _ALL))
    for part in parts:
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += part
        total ^= total >> np.uint64(32)
    return mix(total)


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of the numbers ``start:end`` for many spans: a hash in its upper bits if the numbers are random."""
    t = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * t.up[: len(values)], out=sums[1:])
    out = sums[end]
    out -= sums[start]
    out *= t.down[start]
    return out


def window_sums(values: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """``span_sums`` of all runs of ``n`` numbers inside the spans between ``ends``; a shorter span, not empty, is one run."""
    t, many = _tables(len(values) + 1), len(values)
    sums = np.zeros(many + 1, np.uint64)
    np.cumsum(values * t.up[:many], out=sums[1:])
    whole = max(many - n + 1, 0)
    out = np.zeros(many, np.uint64)
    np.subtract(sums[n:], sums[: whole], out=out[:whole])
    out[:whole] *= t.down[:whole]
    size = np.diff(ends)
    short = np.flatnonzero(size < n)
    first = ends[short]
    out[first] = (sums[ends[short + 1]] - sums[first]) * t.down[first]
    kept = np.ones(many, bool)
    for back in range(1, n):
        kept[ends[1:][size > back] - back] = False
    return out[kept]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the numbers ``start:end`` in order, for many spans that may overlap."""
    return mix(span_sums(values, start, end) + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def bytes_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given slices one after the other, and the offsets of each."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return codes[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def strings(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings over a byte buffer."""
    kind, place = (pa.string(), np.int32) if offsets[-1] < 2**31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(
        kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(place)), pa.py_buffer(np.ascontiguousarray(codes))]
    )
