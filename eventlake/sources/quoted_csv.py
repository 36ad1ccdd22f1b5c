"""Quoted CSV read by many tasks, line breaks inside of quotes included.

A byte range of such a file cannot know by itself whether it begins inside of quotes, so it cannot tell which line breaks end a record. A
parity scan finds out: each range counts its quotes, and what would be odd about them, for both possible states at its
start; put together in order of the ranges, the counts give the true state at every border. Then each task takes the records that begin in
its range, reading on behind its end for the last one, and Spark's own parser types them.

The rows are those of the reader that takes a file in one task. A file whose quotes do not follow RFC 4180 (a quote inside an unquoted
field, text behind a closing quote, lone carriage returns between records) has no such borders; the scan notices, and the file is left to that reader."""

from __future__ import annotations

import csv
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.sources.files import arrow_location

#: Bytes of a file that one task takes, and bytes looked at at once.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Ranges smaller than RANGE_BYTES are made larger where there would be more of them than this: a task costs the same whatever it reads.
SMALL_RANGES = 256
QUOTE, COMMA, LF, CR = 34, 44, 10, 13
BOM = b"\xef\xbb\xbf"


def ranges(spark: SparkSession, files: dict[str, int], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, size, start, length: the files (path -> size) in ranges, each of them a task of its own."""
    many = [-(-size // range_bytes) for size in files.values()]
    listed = spark.sparkContext.broadcast((list(files.items()), list(accumulate(many))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, upto = listed.value
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                f = bisect_right(upto, i)
                path, size = named[f]
                start = (i - (upto[f - 1] if f else 0)) * range_bytes
                rows.append({"path": path, "size": size, "start": start, "length": min(range_bytes, size - start)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))

    return spark.range(0, sum(many), 1, max(1, sum(many))).mapInArrow(place, "path string, size long, start long, length long")


def range_size(files: dict[str, int], least: int = RANGE_BYTES) -> int:
    """Bytes of a range: those asked for, or as many more, up to RANGE_BYTES, as keep the files (path -> size) to SMALL_RANGES."""
    return max(least, min(RANGE_BYTES, -(-sum(files.values()) // SMALL_RANGES)))


def _chunks(file, start: int, end: int, size: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Bytes of [start, end) in chunks, each with the byte before and the byte behind it; a file begins and ends as after a line."""
    for at in range(start, end, CHUNK_BYTES):
        stop = min(end, at + CHUNK_BYTES)
        lo, hi = max(0, at - 1), min(size, stop + 1)
        data = np.frombuffer(file.read_at(hi - lo, lo), np.uint8)
        data = np.concatenate([np.full(int(at == 0), LF, np.uint8), data, np.full(int(stop == size), LF, np.uint8)])
        if at == 0 and data[1:4].tobytes() == BOM:
            data = data.copy()
            data[1:4] = LF
        yield data[1:-1], int(data[0]), int(data[-1])


def crlf_file(file, size: int) -> bool:
    """Whether the first line end of a file is CR LF. The one-task reader takes that for the line end of all of it."""
    for at in range(0, size, 1 << 16):
        data = file.read_at(min(1 << 16, size - at) + 1, at)
        if ends := [i for i in (data.find(b"\n"), data.find(b"\r")) if 0 <= i < 1 << 16]:
            return data[min(ends): min(ends) + 2] == b"\r\n"
    return False


def _scan(data: np.ndarray, before: int, behind: int, quotes: int, crlf: bool) -> tuple[int, int, int]:
    """Quotes of a chunk, and how many places of it are odd if the range begins outside of quotes, or inside of them.
    quotes: those of the range before the chunk."""
    at = np.flatnonzero(data == QUOTE)
    padded = np.concatenate([[before], data, [behind]]).astype(np.uint8)
    prior, after = padded[at], padded[at + 2]
    opens = np.isin(prior, (QUOTE, COMMA, LF))  # a field begins here, or goes on after a doubled quote
    closes = np.isin(after, (QUOTE, COMMA, CR if crlf else LF, LF))
    second = (np.arange(len(at)) + quotes) % 2 == 1
    # a carriage return outside of quotes is part of the file's line end, or nothing the rules know
    lone = np.flatnonzero((data == CR) & ((padded[2:] != LF) | (not crlf)))
    inside = (np.searchsorted(at, lone) + quotes) % 2 == 1
    outside_odd = int((~np.where(second, closes, opens)).sum() + (~inside).sum())
    inside_odd = int((~np.where(second, opens, closes)).sum() + inside.sum())
    return len(at), outside_odd, inside_odd


def parity(cut: DataFrame) -> DataFrame:
    """ranges() with the quotes of each, and odd places for both states at its start: quotes, odd_outside, odd_inside."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, inner = arrow_location(r["path"])
                total = np.zeros(3, np.int64)
                with fs.open_input_file(inner) as file:
                    crlf = crlf_file(file, r["size"])
                    for data, before, behind in _chunks(file, r["start"], r["start"] + r["length"], r["size"]):
                        total += _scan(data, before, behind, int(total[0]), crlf)
                yield pa.RecordBatch.from_pylist([r | dict(zip(("quotes", "odd_outside", "odd_inside"), total.tolist(), strict=True))], schema=schema)

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("quotes", pa.int64()), ("odd_outside", pa.int64()), ("odd_inside", pa.int64())])
    return cut.mapInArrow(task, "path string, size long, start long, length long, quotes long, odd_outside long, odd_inside long")


def states(scanned: DataFrame) -> DataFrame:
    """parity() put together: whether each range begins inside of quotes, and the odd places of its whole file. One small row per range."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = scanned.withColumn("inside", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)) == 1)
    whole = Window.partitionBy("path")
    odd = F.sum(F.when(F.col("inside"), F.col("odd_inside")).otherwise(F.col("odd_outside"))).over(whole)
    open_end = F.pmod(F.sum("quotes").over(whole), F.lit(2))
    return known.select("path", "size", "start", "length", "inside", (odd + open_end).alias("odd"))


def _records(file, start: int, end: int, size: int, inside: bool) -> Iterator[list[bytes]]:
    """The records that begin in [start, end), without the line ends between them. inside: whether start is inside of quotes."""
    rest = b""
    skip = start > 0  # up to the first line end outside of quotes; the record belongs to the range before
    if skip:
        last = file.read_at(1, start - 1)
        # the state at the byte before, whose line end would make a record begin at start
        at, state = start - 1, inside ^ (last == b'"')
    else:
        at, state = 0, False
    while at < size:
        data = file.read_at(min(CHUNK_BYTES, (end if at < end else size) - at), at)
        flat = np.frombuffer(data, np.uint8)
        # sums of single bytes run over at 256, which keeps them even or odd
        odd = (np.cumsum(flat == QUOTE, dtype=np.uint8) + np.uint8(state)) % 2
        breaks = np.flatnonzero((flat == LF) & (odd == 0))
        state = bool(odd[-1])
        if skip and not len(breaks):
            at += len(data)
            if at >= end:
                return  # one record reaches over all of the range
            continue
        if skip and at + int(breaks[0]) >= end - 1:
            return
        done = at + len(data) >= end
        if done:  # the line end that the last record of the range ends with is the first one at end - 1 or behind
            cut = np.searchsorted(breaks, end - 1 - at)
            breaks = breaks[: cut + 1] if cut < len(breaks) else breaks
            done = cut < len(breaks)
        bounds = breaks.tolist()
        first = 0
        if skip:
            first, bounds, skip = bounds[0] + 1, bounds[1:], False
        out = []
        for b in bounds:
            out.append(rest + data[first:b])
            rest, first = b"", b + 1
        yield out
        if done:
            return
        rest += data[first:]
        at += len(data)
    if rest:
        yield [rest]


def records(cut: DataFrame, columns: list[str], inside: set[tuple[str, int]]) -> DataFrame:
    """path and record: the text of each record but the headers. Headers have to name these columns in this order; inside: the ranges (path,
    start) that begin inside of quotes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, inner = arrow_location(r["path"])
                with fs.open_input_file(inner) as file:
                    header, crlf = r["start"] == 0, crlf_file(file, r["size"])
                    for some in _records(file, r["start"], r["start"] + r["length"], r["size"], (r["path"], r["start"]) in known.value):
                        if crlf:  # as the one-task reader has it, also inside of quotes
                            some = [x.removesuffix(b"\r").replace(b"\r\n", b"\n") for x in some]
                        some = [x for x in some if x]  # an empty line is no record
                        if header and some:
                            names = next(csv.reader([some[0].removeprefix(BOM).decode()]))
                            if names != columns:
                                raise ValueError(f"the header of {r['path']} is {names}, not {columns}")
                            some, header = some[1:], False
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string())], names=["path", "record"])

    known = cut.sparkSession.sparkContext.broadcast(inside)
    return cut.mapInArrow(task, "path string, record string")


def read_quoted(spark: SparkSession, files: dict[str, int], columns: list[str], schema: str,
                options: dict[str, str], range_bytes: int = RANGE_BYTES) -> tuple[DataFrame | None, list[str]]:
    """The typed rows of plain CSV files (path -> size), and the files that have to be read in one task each. range_bytes: the smallest ranges
    that they are cut into.

    The driver keeps one state per range that begins inside of quotes, no more than the list of splits that any scan keeps there."""
    if not files:
        return None, []
    range_bytes = range_size(files, range_bytes)
    seen = states(parity(ranges(spark, files, range_bytes))).where("inside or odd > 0").select("path", "start", "inside", "odd").collect()
    odd = {r.path for r in seen if r.odd}
    fit = {f: size for f, size in files.items() if f not in odd}
    if not fit:
        return None, sorted(odd)
    inside = {(r.path, r.start) for r in seen if r.inside and r.path in fit}
    rows = records(ranges(spark, fit, range_bytes), columns, inside)
    return rows.select(F.from_csv("record", schema, options).alias("row")).select("row.*"), sorted(odd)
