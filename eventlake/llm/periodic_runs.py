"""Periodic runs: maximal stretches of a document's words in which words some distance (the period) apart are identical.

An online sparse DP over diagonals. A diagonal is a lag: position i lies on diagonal q if what starts at i started q words
earlier as well, and the match length of a diagonal counts such positions one after another. When the next position leaves the
diagonal, it ends; if it is long enough, its run is emitted at once.

Earlier occurrences of a single word are far too many in a long text (all pairs of a frequent word), so positions are looked at in
scales: at scale g (1, 2, 4, ...) the item at a position is the block of g words that starts there, and the scale answers for the
periods over g/2 up to g. There the nearest earlier occurrence is the only one that counts: a run of smallest period q is
matched over 3q words at least, so blocks of g < 2q words fit in it; were a block in it to occur at a distance d < q as well, the g + d
words from there on would have the periods d and q and so (g >= q, theorem of Fine and Wilf) their greatest common divisor, and
q would not be the smallest. For the same reason multiples of a smallest period are never emitted. A scale names its blocks by
pairs of names of the one before and goes on with blocks that occur twice in their document, which is soon almost none.
So a document of n words takes O(n log n), whatever repeats in it, and nothing is hashed: all names are exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventlake.llm.common import pieces

#: Words of a run at least, and periods of it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 20

Change = Callable[[int | None, list[bytes]], list[bytes]]


class _Names(dict):
    """Numbers things in the order they come."""

    def __missing__(self, thing):
        self[thing] = number = len(self)
        return number


def find_runs(names: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs. names: words as numbers, documents one after another, no number in two of
    them; so no block over a border occurs twice, and no run reaches over one. longest: words of the longest document."""
    found = [np.empty((3, 0), np.int64)]
    at = np.arange(len(names))  # positions whose block occurs twice, and its name
    block, g = names.astype(np.int64), 1
    while len(at) and (g // 2 + 1) * LEAST_PERIODS <= longest:
        order = np.argsort(block, kind="stable")
        value, place = block[order], at[order]
        again = value[1:] == value[:-1]
        # the nearest earlier occurrence gives the diagonal of a position, where the scale answers for it
        lag = np.zeros(len(at), np.int64)
        step = np.diff(place)
        lag[order[1:]] = np.where(again & (step <= g) & (step > g // 2), step, 0)
        on = np.flatnonzero(lag)
        if len(on):
            i, q = at[on], lag[on]
            ends = np.append((i[1:] != i[:-1] + 1) | (q[1:] != q[:-1]), True)
            last = np.flatnonzero(ends)
            first = np.append(0, last[:-1] + 1)
            start, period = i[first] - q[first], q[first]
            length = i[last] + g - start
            enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(np.stack([start, length, period])[:, enough])
        # blocks of 2g words: both halves occur twice, and so may the whole
        name = np.zeros(len(at), np.int64)
        name[order[1:]] = np.cumsum(~again)
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= again
        twice[order[:-1]] |= again
        at, name = at[twice], name[twice]
        half = np.searchsorted(at, at + g)
        both = np.flatnonzero((half < len(at)) & (at[np.minimum(half, len(at) - 1)] == at + g)) if len(at) else half
        block = name[both] * (name.max(initial=0) + 1) + name[half[both]]
        at, g = at[both], 2 * g
    out = np.concatenate(found, axis=1)
    return tuple(out[:, np.lexsort((out[2], out[0]))])


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _slice(ids: list[int | None], texts: list[bytes], change: Change | None) -> list[pa.Array]:
    # words are cut at the six ASCII white-space characters, as bytes.split() does
    words = [t.split() for t in texts]
    if change:
        words = [change(i, w) for i, w in zip(ids, words, strict=True)]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    number = _Names()
    names = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    names += np.repeat(np.arange(len(words)), sizes) * len(number)
    start, length, period = find_runs(names, int(sizes.max(initial=0)))
    doc = np.searchsorted(ends, start, "right")
    # words that repeat what the first period of a run says
    open_ = np.zeros(len(names) + 1, np.int64)
    np.add.at(open_, start + period, 1)
    np.add.at(open_, start + length, -1)
    dropped = np.cumsum(open_[:-1]) > 0
    collapsed = []
    for d, w in enumerate(words):
        gone = dropped[ends[d] - sizes[d]: ends[d]]
        collapsed.append(b" ".join([x for x, out in zip(w, gone.tolist(), strict=True) if not out] if gone.any() else w))
    start = start - (ends - sizes)[doc] if len(doc) else start
    cuts = np.searchsorted(doc, np.arange(len(words) + 1))
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, text -> doc_id, n_words, runs (start, length, period of all runs, by start, then period; words numbered from 0),
    collapsed (the text without the words that any run holds after its first period, joined by one space).

    A run is a stretch of words with smallest period q and length >= max(6, 4 q) that no neighbouring word extends keeping q.
    Whole texts; a null or empty one has no words and no runs. Every row is worked on by itself, so repeated rows, equal and
    missing ids give a row each, an empty table gives none, and other columns are not looked at. change, if given,
    makes the words of a document from its id and words before anything else."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1, BYTES_AT_ONCE):
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([ids, *_slice(ids.to_pylist(), _texts(b.column(1)), change)], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
