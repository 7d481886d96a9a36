"""Shared helpers: column access, text as flat bytes, words and shingles as hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import materialize

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: byte -> byte with A-Z lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes that belong to words when words are split at ASCII white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: bytes that belong to words when words are runs of letters and digits (after lower-casing)
LETTER_OR_DIGIT = np.zeros(256, dtype=bool)
LETTER_OR_DIGIT[48:58] = LETTER_OR_DIGIT[97:123] = LETTER_OR_DIGIT[128:] = True

_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER_CASE)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; other columns, whatever their names, are left behind."""
    return df.select(*[df[f"`{name}`"].alias(new) for new, name in columns.items()])


def skewed_join(rows: DataFrame, side: DataFrame, keys: list[str], count: str, shares: int = 10_000) -> DataFrame:
    """The inner join of rows with side, which has each key once and in `count` how many of the rows have it.

    Keys with more than one in `shares` of the rows, fewer than `shares` of them whatever the data, are broadcast;
    the other rows are exchanged by key, and none of those keys is large. Both inputs are read twice: pass stored tables.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = side.filter(F.col(count) * shares > total)
    cold = side.filter(F.col(count) * shares <= total)
    spread = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(spread)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; the shuffle files that led to it can go.

    Spark's cleaner removes the files of shuffles that no plan refers to any more, as soon as a garbage collection
    finds them; a driver with memory to spare may not run one for long, so ask for it.
    """
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the offset of each row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that a piece has at most max_bytes of text or is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column))
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers wait for later tasks and keep what they hold


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of member bytes inside one row) and the count of words per row."""
    inside = member[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, np.ndarray] = {}


def _table(n: int, base: int) -> np.ndarray:
    held = _tables.get(base)
    if held is None or len(held) < n:
        held = _powers(max(n, _CHUNK), base)
        if n <= 2 * _CHUNK:
            _tables[base] = held
    return held


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, worked out in chunks of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _CHUNK, "right")))
        base, stop = int(starts[a]), int(ends[b - 1])
        n = stop - base
        values = (data[base:stop].astype(np.uint64) + np.uint64(1)) * _table(n, _BASE)[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        own = sums[ends[a:b] - base] - sums[starts[a:b] - base]
        out[a:b] = mix(own * _table(n, inverse)[starts[a:b] - base] + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out


def window_hashes(data: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place that has so many before the end."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    letters = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(salt << 20))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * _table(len(data), _BASE)[: len(data)], out=sums[1:])
    n = len(data) - size + 1
    return mix((sums[size:] - sums[:n]) * _table(len(data), inverse)[:n])


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and how many each row has.

    A row with fewer words, but not none, has one shingle: its whole sequence.
    """
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(begin, many) + rank
    left = np.repeat(begin + counts, many)
    out = np.repeat(np.minimum(counts, size).astype(np.uint64), many)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for i in range(size):
        value = np.where(at + i < left, padded[at + i], np.uint64(0))
        out = mix(out * np.uint64(_BASE) + value)
    return out, many
