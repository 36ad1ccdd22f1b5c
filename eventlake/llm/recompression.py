"""Repeated word windows by recompression.

Words are named by hashes. Rounds then name runs of a symbol, and pairs of symbols of which the first is of the left and
the second of the right half of the names (a bit of the name): names depend on content alone, so they are the
same in all tasks. Equal windows get equal symbols but for their borders: what a border could join with is
not counted, the rest is the window's core. A window's anchor is the symbol of the smallest name in its core, at the
highest round that leaves one; its key also covers the words that made it certain. Spark brings equal keys of
all documents together (anchored.py); where fragments around a key differ, each window's whole content is compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm import anchored
from eventlake.llm.common import BYTE_VALUES, byte_view, mix64, block_hashes, slices, stored, word_spans

WINDOW = 13
PAIR_ROUNDS = 3
#: Bytes of text worked on at once. Longer texts go in parts that overlap by a window.
PART = 1 << 18


@dataclass
class Round:
    """Symbols of a round: name, start (and the end of the last). left, right: for each word, the first certain border
    of a window that begins there, and the last one of a window that ends there."""
    name: np.ndarray
    start: np.ndarray
    left: np.ndarray
    right: np.ndarray


def rounds(words: np.ndarray, first: np.ndarray, pair_rounds: int = PAIR_ROUNDS) -> list[Round]:
    """words: hashes; first: whether a word is the first of its text. Round 0 are the words, round 1 their runs."""
    n = len(words)
    here = np.arange(n + 1)
    out = [Round(words, here, here, here)]
    name, start, opens = words, here, first
    for r in range(1 + pair_rounds):
        begin, end = start[:-1], start[1:]
        ahead, back = here.copy(), here.copy()
        if r == 0:
            new = opens.copy()
            new[1:] |= name[1:] != name[:-1]
            heads = np.flatnonzero(new)
            lengths = np.diff(np.concatenate((heads, [len(name)])))
            # a run at a border could reach over it
            ahead[begin] = np.repeat(end[heads + lengths - 1], lengths)
            back[end] = np.repeat(begin[heads], lengths)
            name = np.where(lengths > 1, mix64(name[heads] + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), name[heads])
        else:
            second = (mix64(name + np.uint64(r * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
            # a right symbol at the front could be a pair's second, a left symbol at the end a pair's first
            ahead[begin[second]] = end[second]
            back[end[~second]] = begin[~second]
            joins = np.zeros(len(name), bool)
            joins[1:] = second[1:] & ~second[:-1] & ~opens[1:]
            heads = np.flatnonzero(~joins)
            paired = np.zeros(len(name), bool)
            paired[:-1] = joins[1:]
            after = np.concatenate((name[1:], name[:1]))
            name = np.where(paired, mix64(name * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(after) + np.uint64(r)), name)[heads]
        start, opens = np.concatenate((begin[heads], start[-1:])), opens[heads]
        out.append(Round(name, start, ahead[out[-1].left], back[out[-1].right]))
    return out


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all texts: (window start, first and last certain word of its anchor, round)."""
    n = len(words)
    ends = np.concatenate((np.flatnonzero(first)[1:], [n]))
    text_end = ends[np.cumsum(first) - 1]
    open_ = np.flatnonzero(np.arange(n) + window <= text_end)
    where, lo, hi, level = [], [], [], []
    steps = rounds(words, first)
    for r in range(len(steps) - 1, 0, -1):
        s = steps[r]
        symbol = np.zeros(n + 1, np.int64)
        symbol[s.start] = np.arange(len(s.start))
        a, b = s.left[open_], s.right[open_ + window]
        core = a < b
        i = open_[core]
        x, y = symbol[a[core]], symbol[b[core]]
        best, least = x.copy(), s.name[x]
        k = 1
        more = np.flatnonzero(x + k < y)
        while len(more):
            j = x[more] + k
            less = s.name[j] < least[more]
            best[more[less]], least[more[less]] = j[less], s.name[j[less]]
            k += 1
            more = more[x[more] + k < y[more]]
        where.append(i)
        lo.append(np.searchsorted(s.left[:n], s.start[best], "right") - 1)
        hi.append(np.searchsorted(s.right, s.start[best + 1], "left"))
        level.append(np.full(len(i), r))
        open_ = open_[~core]
    # runs fill these windows: each is its own anchor
    where.append(open_)
    lo.append(open_)
    hi.append(open_ + window)
    level.append(np.zeros(len(open_), np.int64))
    order = np.argsort(np.concatenate(where), kind="stable")
    return tuple(np.concatenate(c)[order] for c in (where, lo, hi, level))


def parts(flat: np.ndarray, at: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of byte_view() in parts of about PART bytes: (word hashes, row of each word, place of each word in its text, whether it begins a
    text or part)."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        piece, bounds = flat[at[i]: at[j]], at[i: j + 1] - at[i]
        starts, ends, before = word_spans(piece, bounds)
        row = np.repeat(np.arange(i, j), np.diff(before))
        place = np.arange(len(starts)) - np.repeat(before[:-1], np.diff(before))
        if j > i + 1 or len(piece) <= PART:
            yield block_hashes(BYTE_VALUES[piece], starts, ends, 1), row, place, place == 0
        else:
            k = 0
            while k < len(starts):
                m = max(k + 4 * window, int(np.searchsorted(ends, starts[k] + PART, "right")))
                m = min(m, len(starts))
                lo = starts[k]
                head = np.zeros(m - k, bool)
                head[0] = True
                yield block_hashes(BYTE_VALUES[piece[lo: ends[m - 1]]], starts[k:m] - lo, ends[k:m] - lo, 1), row[k:m], place[k:m], head
                k = m if m == len(starts) else m - window + 1
        i = j


def _fragments(window: int):
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, subs, tags = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)
        flat, at = byte_view(b.column(3))
        for words, row, place, first in parts(flat, at, window):
            if not len(words):
                continue
            i, lo, hi, level = anchors(words, first, window)
            if not len(i):
                continue
            new = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (level[1:] != level[:-1]) | first[i[1:]]))
            head = np.flatnonzero(new)
            a, n = i[head], np.diff(np.concatenate((head, [len(i)])))
            key = block_hashes(words, lo[head], hi[head], 3) ^ mix64((level[head] + 1).astype(np.uint64))
            begin, n, index = anchored.cut_long(a, n)
            frag = block_hashes(words, begin, begin + n - 1 + window, 4)
            yield key[index].view(np.int64), frag.view(np.int64), ids[row[begin]], subs[row[begin]], anchored.pack(place[begin], tags[row[begin]], n)
    return of


def _single_windows(window: int):
    """Asked ranges of texts -> each window with two hashes of its whole content."""
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        ids, subs, tags, ats = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), b.column(4)
        flat, at = byte_view(b.column(3))
        for words, row, place, first in parts(flat, at, window):
            heads = np.flatnonzero(first)
            for h, e in zip(heads, np.concatenate((heads[1:], [len(words)])), strict=True):
                r = int(row[h])
                wanted = ats[r].values.to_numpy()
                start, n = anchored.start_of(wanted), anchored.n_of(wanted)
                i = np.unique(np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) - place[h] + h
                i = i[(i >= h) & (i + window <= e)]
                if len(i):
                    yield (block_hashes(words[h:e], i - h, i - h + window, 5).view(np.int64), block_hashes(words[h:e], i - h, i - h + window, 6).view(np.int64),
                           np.full(len(i), ids[r]), np.full(len(i), subs[r]), anchored.pack(place[i], np.full(len(i), tags[r]), np.ones(len(i), np.int64)))
    return of


def _removed(window: int):
    """Texts with their covered ranges -> what is kept."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for i, (text, ats) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                if ats.is_valid:
                    a = ats.values.to_numpy()
                    np.add.at(gone, anchored.start_of(a), 1)
                    np.add.at(gone, anchored.start_of(a) + anchored.n_of(a) - 1 + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if ats.is_valid else b" ".join(words)
                out.append((len(words), int(len(words) - keep.sum()), kept))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return task


def covered_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts with tags, ranges of windows that occur in a document with a smaller id)."""
    texts = docs.select(F.col("doc_id").alias("doc"), anchored.text_key(F.col("text")).alias("sub"), anchored.tag(F.col("text")).alias("tag"), "text")
    known = texts.where("doc is not null and text is not null")
    found = stored(anchored.meet(anchored.map_fragments(known, _fragments(window), smaller=True), smaller=True), "fragments")
    asked = anchored.by_document(anchored.asked(found), known, "inner", ["doc", "sub", "tag", "text", "ats"])
    single = stored(anchored.covered(anchored.meet(anchored.map_fragments(asked, _single_windows(window), smaller=True), smaller=True)), "windows")
    return texts, anchored.covered(found).unionByName(single)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, kept_sha256, kept (binary: the kept words joined by one space).

    A word goes if a window of so many words covers it that also starts in a document with a smaller doc_id.
    Null texts have no words. A document without an id is compared with none and loses nothing. Rows with the same id do not count against each
    other. Texts below a window stay whole."""
    texts, ranges = covered_windows(docs, window)
    both = anchored.by_document(ranges, texts, "left", ["doc", "text", "ats"])
    return both.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
