"""Windows that occur again elsewhere, found by anchors.

A window is so many consecutive units (bytes or words) of a text. Every window owns an anchor inside it that its
content alone decides, so equal windows have equal anchors. Windows that follow each other mostly share theirs: such a
run of windows is a fragment. Only a key of the anchor and a hash of the fragment are shuffled:

1. in a map task, equal fragments are settled on the spot, and one of them goes on;
2. fragments meet by key; equal ones are settled, and a key with one fragment only is done;
3. where fragments of a key differ, their windows are asked for one by one, by what stands in the text.

Rows of a fragment: key, frag, doc (a document's id or a hash that stands for it), sub (tells apart the texts of a doc), at (packed place) and kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import sorted_runs, stored

SCHEMA = "key long, frag long, doc long, sub long, at long, kind int"
RANGES = "doc long, sub long, at long, state int"
#: kind of a row: one fragment, one that stands for several, or windows that are settled.
ONE, SEVERAL, SETTLED = 0, 1, 2
#: state of a result: covered windows, windows to ask for, windows that only answer.
COVERED, ASK, ANSWER = 1, 2, 3
MAX_N = 0xFFFF
#: Fragments that a map task settles at once.
FLUSH = 1 << 20


def tag(text: Column) -> Column:
    """16 bits of a text that go with its place."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 16)).cast("int")


def text_key(text: Column, *of: Column) -> Column:
    """64 bits of a text (and what else is given); with the tag, 80 bits tell texts apart."""
    return F.xxhash64(*of, F.md5(text))


def pack(start: np.ndarray, tags: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start << 32 | tags << 16 | n


def start_of(at: np.ndarray) -> np.ndarray:
    return at >> 32


def tag_of(at: np.ndarray) -> np.ndarray:
    return at >> 16 & 0xFFFF


def n_of(at: np.ndarray) -> np.ndarray:
    return at & MAX_N


def cut_long(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of more windows than a row holds, in pieces; with the index each piece comes from."""
    pieces = np.maximum(1, -(-n // MAX_N))
    index = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return start[index] + nth * MAX_N, np.minimum(MAX_N, n[index] - nth * MAX_N), index


def merged(doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows, those that follow each other in one."""
    if not len(doc):
        return doc, sub, at
    order = np.lexsort((start_of(at), tag_of(at), sub, doc))
    doc, sub, at = doc[order], sub[order], at[order]
    start, tags, end = start_of(at), tag_of(at), start_of(at) + n_of(at)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (tags[1:] != tags[:-1]) | (start[1:] != end[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    begin, n, index = cut_long(start[first], end[last] - start[first])
    return doc[first][index], sub[first][index], pack(begin, tags[first][index], n)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Number of the group of equal values, of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _batches(columns: list[np.ndarray], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i: i + (1 << 16)], t) for c, t in zip(columns, types, strict=True)], names=names)


_NAMES = ["key", "frag", "doc", "sub", "at", "kind"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def settle_locally(rows: list[tuple[np.ndarray, ...]], smaller: bool) -> Iterator[pa.RecordBatch]:
    """rows: arrays of key, frag, doc, sub, at. smaller: windows are covered if they occur in a document with a smaller id;
    else if they occur anywhere else."""
    if not rows:
        return
    key, frag, doc, sub, at = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((at, sub, doc, frag, key))
    key, frag, doc, sub, at = key[order], frag[order], doc[order], sub[order], at[order]
    group = _groups(key, frag)
    first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1)) if len(group) else np.empty(0, np.int64)
    if smaller:
        settled = doc > doc[first][group]
        lead = ~settled
        kind = np.full(int(lead.sum()), ONE, np.int32)
    else:
        several = np.bincount(group)[group] > 1
        settled = several
        lead = np.zeros(len(key), bool)
        lead[first] = True
        kind = np.where(several[lead], SEVERAL, ONE).astype(np.int32)
    yield from _batches([key[lead], frag[lead], doc[lead], sub[lead], at[lead], kind], _NAMES, _TYPES)
    d, s, a = merged(doc[settled], sub[settled], at[settled])
    # settled rows take any way through the shuffle
    yield from _batches([d * 0x9E3779B97F4A7C1 + (a >> 3), np.zeros(len(d), np.int64), d, s, a, np.full(len(d), SETTLED, np.int32)], _NAMES, _TYPES)


def map_fragments(texts: DataFrame, fragments: Callable[[pa.RecordBatch], Iterator[tuple]], smaller: bool) -> DataFrame:
    """texts -> rows of fragments. fragments gives arrays (key, frag, doc, sub, at) for the texts of a batch, in parts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in fragments(b):
                held.append(part)
                size += len(part[0])
                if size > FLUSH:
                    yield from settle_locally(held, smaller)
                    held, size = [], 0
        yield from settle_locally(held, smaller)
    return texts.mapInArrow(task, SCHEMA)


def _meet(smaller: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in sorted_runs(batches, ["key"]):
            key, frag, doc, sub, at, kind = (table[c].to_numpy() for c in _NAMES)
            done = kind == SETTLED
            outs = [(doc[done], sub[done], at[done], COVERED)]
            key, frag, doc, sub, at, kind = (c[~done] for c in (key, frag, doc, sub, at, kind))
            if len(key):
                run, group = _groups(key), _groups(key, frag)
                first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
                per_run = np.bincount(run[first])
                differ = per_run[run] > 1
                if smaller:
                    lowest = np.full(run[-1] + 1, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, run, doc)
                    covered = doc > doc[first][group]
                    ask = differ & ~covered & (doc > lowest[run])
                    answer = differ & ~covered & ~ask
                    outs.append((doc[covered], sub[covered], at[covered], COVERED))
                else:
                    again = (np.bincount(group) > 1) | (np.bincount(group, kind == SEVERAL) > 0)
                    repeated = again[group]
                    covered = repeated & (kind == ONE)
                    ask = differ & ~repeated
                    head = np.zeros(len(key), bool)
                    head[first] = True
                    answer = differ & repeated & head
                    outs.append((doc[covered], sub[covered], at[covered], COVERED))
                outs += [(doc[ask], sub[ask], at[ask], ASK), (doc[answer], sub[answer], at[answer], ANSWER)]
            d, s, a = (np.concatenate([o[i] for o in outs]) for i in range(3))
            yield from _batches([d, s, a, np.repeat(np.array([o[3] for o in outs], np.int32), [len(o[0]) for o in outs])], ["doc", "sub", "at", "state"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()])
    return task


def meet(fragments: DataFrame, smaller: bool) -> DataFrame:
    """Rows of fragments, brought together by key -> doc, sub, at, state."""
    placed = fragments.repartition("key").sortWithinPartitions("key", "frag", "doc")
    return placed.mapInArrow(_meet(smaller), RANGES)


def by_document(ranges: DataFrame, docs: DataFrame, how: str, columns: list[str]) -> DataFrame:
    """docs (doc, sub, tag, text) with their ranges: ats, states (arrays; as many as a document has)."""
    tags = F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    per = ranges.groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub"), tags.alias("_tag")).agg(F.collect_list("at").alias("ats"), F.collect_list("state").alias("states"))
    return docs.join(per, (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")) & (F.col("tag") == F.col("_tag")), how).select(*columns)


def asked(found: DataFrame) -> DataFrame:
    return found.where(F.col("state").isin(ASK, ANSWER))


def covered(found: DataFrame) -> DataFrame:
    return found.where(F.col("state") == COVERED)


__all__ = ["ASK", "ANSWER", "COVERED", "MAX_N", "RANGES", "asked", "by_document", "covered", "cut_long", "map_fragments", "meet", "merged", "n_of", "pack", "start_of", "stored", "tag", "tag_of", "text_key"]
