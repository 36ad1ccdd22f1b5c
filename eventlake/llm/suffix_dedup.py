"""Repeated byte strings, by merged Burrows-Wheeler transforms.

All suffixes of a corpus are too many for a table. What cannot repeat is left out first: a window of 200 bytes has
its anchor in its 40 bytes of the smallest hash, and Spark brings equal anchors together (anchored.py); fragments that are equal are one
string with a count. Where fragments of an anchor differ, their windows are cut again by a longer anchor, the
bytes are shuffled by it, and each task builds the transforms of its shards of strings and merges them by
interleave refinement (bwt.py). Intervals of suffixes with a common prefix of 200 bytes are the repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm import anchored, bwt
from eventlake.llm.common import BYTE_VALUES, byte_view, mix64, range_hashes, slices, sorted_runs, stored

WINDOW = 200
#: Bytes of an anchor, and of the second one.
ANCHOR, SECOND = 40, 100
#: Bytes of text worked on at once, few enough for a core's cache; longer texts go in parts that overlap by a window.
PART = 1 << 18
#: Bytes of strings whose transforms are merged at once, about.
MERGE = 1 << 21
#: Strings of one anchor, at most; more are compared window by window, by Spark.
CROWD = 4096


def least_places(order: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the smallest of the next `span` 32-bit values stands; the first one of equals."""
    v = order.astype(np.uint64) << np.uint64(32) | np.arange(len(order), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if span > width:
        v = np.minimum(v[: len(v) - (span - width)], v[span - width:])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def parts(flat: np.ndarray, at: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of byte_view() in parts: (bytes, borders of its texts, row of each text, place of its first byte)."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        if j > i + 1 or at[j] - at[i] <= PART:
            yield flat[at[i]: at[j]], at[i: j + 1] - at[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            k, n = 0, int(at[j] - at[i])
            while True:
                m = min(n, k + PART)
                yield flat[at[i] + k: at[i] + m], np.array([0, m - k]), np.array([i]), np.array([k])
                if m == n:
                    break
                k = m - window + 1
        i = j


def fragments(flat: np.ndarray, borders: np.ndarray, anchor: int, seed: int, window: int = WINDOW, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, frag, start, number of windows, text) of the runs of windows that share an anchor; of `wanted` windows only, if given."""
    empty = (np.empty(0, np.int64),) * 5
    if len(flat) < window:
        return empty
    values = BYTE_VALUES[flat]
    here = np.arange(len(flat) - anchor + 1)
    grams = range_hashes(values, here, here + anchor, seed)
    where = least_places((mix64(grams) >> np.uint64(32)).astype(np.uint32), window - anchor + 1)
    lengths = np.diff(borders)
    ends = np.repeat(borders[1:], lengths)
    fits = np.arange(len(flat)) + window <= ends
    if wanted is not None:
        fits &= wanted
    i = np.flatnonzero(fits)
    if not len(i):
        return empty
    p = where[i]
    head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1))))
    a, n = i[head], np.diff(np.concatenate((head, [len(i)])))
    text = np.searchsorted(borders, a, "right") - 1
    return grams[p[head]].view(np.int64), range_hashes(values, a, a + n - 1 + window, seed + 1).view(np.int64), a, n, text


def _fragments(window: int):
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, subs, tags = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
        flat, at = byte_view(b.column(3))
        for piece, borders, rows, first in parts(flat, at, window):
            key, frag, a, n, t = fragments(piece, borders, ANCHOR, 11, window)
            if len(key):
                yield key, frag, ids[rows[t]], subs[rows[t]], anchored.pack(a - borders[t] + first[t], tags[rows[t]], n)
    return of


STRINGS = "key long, doc long, sub long, at long, state int, string binary"


def _strings(window: int):
    """Texts with asked ranges -> strings of windows that share a second anchor."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, tags = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            flat, at = byte_view(b.column(3))
            for piece, borders, rows, first in parts(flat, at, window):
                state = np.zeros(len(piece) + 1, np.int8)
                for t, r in enumerate(rows.tolist()):
                    start, n = anchored.start_of(b.column(4)[r].values.to_numpy()), anchored.n_of(b.column(4)[r].values.to_numpy())
                    asks = b.column(5)[r].values.to_numpy() == anchored.ASK
                    for kind, chosen in ((anchored.ANSWER, ~asks), (anchored.ASK, asks)):
                        lo = np.clip(start[chosen] - first[t] + borders[t], borders[t], borders[t + 1])
                        hi = np.clip(start[chosen] + n[chosen] - first[t] + borders[t], borders[t], borders[t + 1])
                        on = np.zeros(borders[t + 1] - borders[t] + 1, np.int32)
                        np.add.at(on, lo - borders[t], 1)
                        np.add.at(on, hi - borders[t], -1)
                        state[borders[t]: borders[t + 1]][np.cumsum(on)[:-1] > 0] = kind
                for kind in (anchored.ASK, anchored.ANSWER):
                    key, _, a, n, t = fragments(piece, borders, SECOND, 21, window, state[:-1] == kind)
                    if len(key):
                        raw = piece.tobytes()
                        packed = anchored.pack(a - borders[t] + first[t], tags[rows[t]], n)
                        for i in range(0, len(key), 4096):
                            s = slice(i, i + 4096)
                            strings = [raw[x: x + m - 1 + window] for x, m in zip(a[s].tolist(), n[s].tolist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(ids[rows[t[s]]]), pa.array(subs[rows[t[s]]]), pa.array(packed[s]), pa.array(np.full(len(strings), kind, np.int32)), pa.array(strings, pa.binary())],
                                                             names=["key", "doc", "sub", "at", "state", "string"])
    return task


def _judge(doc: np.ndarray, sub: np.ndarray, at: np.ndarray, state: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of repeated windows of the asked strings."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings])
    weight = np.minimum(2, np.bincount(which, np.where(state == anchored.ANSWER, 2, 1)))
    again = bwt.repeated(list(number), weight, window)
    docs, subs, places = [], [], []
    for r in np.flatnonzero(state == anchored.ASK):
        flags = again[which[r]]
        edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(lo):
            docs.append(np.full(len(lo), doc[r]))
            subs.append(np.full(len(lo), sub[r]))
            places.append(anchored.pack(anchored.start_of(at[r]) + lo, anchored.tag_of(at[r]), hi - lo))
    if not docs:
        return (np.empty(0, np.int64),) * 3
    return anchored.merged(np.concatenate(docs), np.concatenate(subs), np.concatenate(places))


def _merged_transforms(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def judged() -> Iterator[pa.RecordBatch]:
            doc, sub, at, state = (np.concatenate([h[i] for h in held]) for i in range(4))
            d, s, a = _judge(doc, sub, at, state, [x for h in held for x in h[4]], window)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(a), pa.array(np.full(len(d), anchored.COVERED, np.int32))], names=["doc", "sub", "at", "state"])

        for table, bounds in sorted_runs(batches, ["key"]):
            doc, sub, at, state = (table[c].to_numpy() for c in ("doc", "sub", "at", "state"))
            strings = table["string"]
            for r in np.flatnonzero(np.diff(bounds) > 1):
                run = slice(int(bounds[r]), int(bounds[r + 1]))
                if (state[run] == anchored.ASK).any():
                    held.append((doc[run], sub[run], at[run], state[run], strings[run].to_pylist()))
                    size += sum(map(len, held[-1][4]))
                    if size > MERGE:
                        yield from judged()
                        held, size = [], 0
        if held:
            yield from judged()
    return task


def _crowded_windows(window: int):
    """Strings -> their windows, each by two hashes of all its bytes."""
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        for doc, sub, at, string in zip(*(b.column(c).to_numpy().tolist() for c in range(3)), b.column(3), strict=True):
            values = BYTE_VALUES[np.frombuffer(string.as_buffer(), np.uint8)]
            i = np.arange(len(values) - window + 1)
            place = anchored.pack(anchored.start_of(np.int64(at)) + i, np.full(len(i), anchored.tag_of(np.int64(at))), np.ones(len(i), np.int64))
            yield range_hashes(values, i, i + window, 31).view(np.int64), range_hashes(values, i, i + window, 32).view(np.int64), np.full(len(i), doc), np.full(len(i), sub), place
    return of


def covered_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts with tags, ranges of windows that occur anywhere else, too)."""
    # ids are not compared here, so each id and text goes by one hash, and a missing id is an id like others
    texts = docs.select("doc_id", anchored.text_key(F.col("text"), F.col("doc_id")).alias("doc"), F.lit(0).cast("long").alias("sub"), anchored.tag(F.col("text")).alias("tag"), "text")
    known = texts.where("text is not null")
    found = stored(anchored.meet(anchored.map_fragments(known.select("doc", "sub", "tag", "text"), _fragments(window), smaller=False), smaller=False), "fragments")
    asked = anchored.by_document(anchored.asked(found), known.select("doc", "sub", "tag", "text").distinct(), "inner", ["doc", "sub", "tag", "text", "ats", "states"])
    strings = stored(asked.mapInArrow(_strings(window), STRINGS), "strings")
    crowded = stored(strings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "crowded")
    few = strings.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    single = few.mapInArrow(_merged_transforms(window), anchored.RANGES)
    many = strings.join(crowded, "key", "left_semi").select("doc", "sub", "at", "string", "state")
    windows = anchored.meet(anchored.map_fragments(many, _crowded_windows(window), smaller=False), smaller=False)
    return texts, anchored.covered(found).unionByName(stored(single.unionByName(anchored.covered(windows)), "windows"))


def _removed(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, ats in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not ats.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                a = ats.values.to_numpy()
                on = np.zeros(len(raw) + 1, np.int64)
                np.add.at(on, anchored.start_of(a), 1)
                np.add.at(on, anchored.start_of(a) + anchored.n_of(a) - 1 + window, -1)
                gone = np.cumsum(on)[:-1] > 0
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(k).hexdigest() for k in columns[3]], pa.string()),
                                              pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return task


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that are left).

    A byte goes if a string of `window` bytes covers it that starts anywhere else, too, in this text or another.
    Null texts are empty. Texts below a window stay whole; repeated rows repeat each other, whatever their ids."""
    texts, ranges = covered_windows(docs, window)
    both = anchored.by_document(ranges, texts, "left", ["doc_id", "text", "ats"])
    return both.mapInArrow(_removed(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
