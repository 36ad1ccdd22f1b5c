"""What the operators share: tables, words, tables kept in the shared folder, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.session import new_scratch

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and still there when executors are lost."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row in one, so that their names cannot meet an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. Texts without other letters take the short way, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Rows of texts worked on at once.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in smaller ones, so that what a task makes of a batch stays small."""
    try:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    finally:
        # a worker goes on to other tasks, and what it holds for nothing counts as the executor's memory
        pa.default_memory_pool().release_unused()


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of `most` bytes of the text column at most, or of one row."""
    for b in slices(batches):
        _, at = byte_view(b.column(text))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0]: at[-1]], at - at[0]


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of byte_view()'s rows, and for each row how many words come before it."""
    if not len(flat):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    cut = np.zeros(len(flat) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([True], space[:-1])) | cut[:-1]
    after = np.concatenate((space[1:], [True])) | cut[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each range, by prefix sums of a polynomial in an odd base; depends on
    content and length alone. values: uint64, already spread."""
    base = (0x9E3779B97F4A7C15 + 2 * seed) & (2 ** 64 - 1) | 1
    n = len(values)
    if seed not in _POWERS or len(_POWERS[seed][0]) <= n:
        size, inverse = max(n + 1, 1 << 16), pow(base, -1, 2 ** 64)
        grown = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        _POWERS[seed] = (grown[0], grown[1])
    up, down = _POWERS[seed]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def block_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each range; depends on content and length alone. values: uint64, already spread.

    Two overlapping blocks of a power of two of values cover a range; blocks are named from their halves, level by level, and spread at
    each. Unlike a polynomial modulo 2^64 (range_hashes), no content is known by which it could be led astray: that one
    takes a Thue-Morse string and its complement for the same."""
    length = ends - starts
    out = np.full(len(starts), mix64(np.array([seed], np.uint64))[0], np.uint64)
    level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
    level[length <= 0] = -1
    salt = np.uint64(seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    held, size = mix64(values + salt), 1
    for k in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == k)
        one, two = held[starts[here]], held[ends[here] - size]
        out[here] = mix64(mix64(one + length[here].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + two * np.uint64(0xC2B2AE3D27D4EB4F))
        if k < level.max():
            held = mix64(held[:-size] * np.uint64(0x9FB21C651E98DF25) + mix64(held[size:] ^ salt))
            size *= 2
    return out


#: Random 64-bit values of the 256 bytes, the same everywhere.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of rows that are sorted by keys (64-bit or 32-bit whole numbers), cut between runs of equal keys, with the
    bounds of the runs. Holds one batch and the run that reaches over its end."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            last = int(bounds[-2])
            yield table.slice(0, last), bounds[:-1]
            table = table.slice(last)
        rest = table
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        v = table[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))


def text_join(parts: Column) -> Column:
    """One text of an array of texts, nothing between."""
    return F.array_join(parts, "")
