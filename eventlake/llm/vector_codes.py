"""Vector code compression: vectors are cut into parts, each part is replaced by the number of the nearest entry of its position's codebook.

Assignment walks a lexicographic trie over the distinct parts. A node is a prefix of dimensions and holds the distances of that prefix to
all entries, accumulated from its parent's with one dimension more; parts with a common prefix share all of that. The walk
goes depth first, so only the accumulated vectors of one path are held; neighbouring subtrees that are small together are
finished at once, level by level, again one row per distinct prefix. A leaf takes the argmin and adds its part, weighted by how many
vectors have it, to the sums of that entry.

All is whole numbers: components are floor(1024 x), distances and sums are exact, so any order of work gives the same codes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices, stored

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components have to stay below this as whole numbers, so that squares and sums of them fit 64 bits.
LARGEST = 1 << 25
#: Distinct parts of neighbouring subtrees that are finished at once, and vectors that a task holds at once.
LEAVES, ROWS = 512, 8192


# ---- the trie --------------------------------------------------------------------------------------

def _finish(parts: np.ndarray, new: np.ndarray, depth: int, acc: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Distances of sorted distinct parts to all entries, from those of their common prefix of `depth` dimensions. new[i]: the first
    dimension in which part i differs from the one before."""
    node = np.zeros(len(parts), np.int64)  # node of each part at this depth, and each node's distances
    held = acc[None, :]
    for j in range(depth, parts.shape[1]):
        first = new <= j
        first[0] = True
        at = np.flatnonzero(first)
        held = held[node[at]] + (parts[at, j][:, None] - book[None, :, j]) ** 2
        node = np.cumsum(first) - 1
    return held[node]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct parts (rows of whole numbers): the nearest entry of the book, the lowest of equally near ones, and its squared distance."""
    m, d = parts.shape
    entry, distance = np.zeros(m, np.int64), np.zeros(m, np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * largest ** 2 * d < 1 << 53:  # doubles are exact as far as that, and faster
        parts, book = parts.astype(np.float64), book.astype(np.float64)
    new = np.zeros(m, np.int64)
    if m:
        new[1:] = (parts[1:] != parts[:-1]).argmax(axis=1)
    todo = [(0, m, 0, np.zeros(len(book), book.dtype))] if m else []
    while todo:
        lo, hi, depth, acc = todo.pop()
        if depth == d or hi - lo <= LEAVES:
            held = _finish(parts[lo:hi], new[lo:hi], depth, acc, book)
            entry[lo:hi] = held.argmin(axis=1)
            distance[lo:hi] = held[np.arange(hi - lo), entry[lo:hi]]
            continue
        cuts = [lo, *(np.flatnonzero(new[lo + 1: hi] <= depth) + lo + 1).tolist(), hi]
        children, i = [], 0
        while i + 1 < len(cuts):
            j = i + 1
            while j + 1 < len(cuts) and cuts[j + 1] - cuts[i] <= LEAVES:
                j += 1
            if j == i + 1:
                children.append((cuts[i], cuts[j], depth + 1, acc + (parts[cuts[i], depth] - book[:, depth]) ** 2))
            else:  # small neighbours, finished from their parent's distances
                children.append((cuts[i], cuts[j], depth, acc))
            i = j
        todo.extend(reversed(children))
    return entry, distance


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows, and for each row its place among them."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)) if len(parts) else np.zeros(0, bool)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place


# ---- Spark ----------------------------------------------------------------------------------------

def _whole(vector: Column) -> Column:
    """floor(1024 x) of each component; the product is exact, as a power of two only moves the exponent."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that are coded.

    Dropped: vectors that are null, empty, or hold null or non-finite components, and those of another length than the first kept
    row's (by vec_id, then vector); none of a length that the parts do not divide are kept. Components of 32,768 or more in size
    stop the job, as their squares would not be exact."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select("vec_id", "label", F.col("embedding").alias("v")).where(fine)
    fits = F.forall("v", lambda x: F.abs(x) < LARGEST / SCALE)
    checked = kept.withColumn("v", F.when(fits, _whole(F.col("v"))).otherwise(F.raise_error(F.lit("a component is 32,768 or more in size")).cast("array<bigint>")))
    whole = stored(checked, "whole-vectors")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    return whole if first is None else whole.where(F.size("v") == first.n)


def distinct_parts(vectors: DataFrame) -> DataFrame:
    """pos, part, weight: how many vectors have the part there. Counted on the map side first, so a frequent vector is one row per task;
    stored in order, so that tasks get neighbours of the trie."""
    width = F.expr(f"size(v) div {PARTS}")
    each = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("v", width * p + 1, width).alias("part")) for p in range(PARTS)])
    counted = vectors.select(F.inline(each)).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    return stored(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "distinct-parts")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(books: np.ndarray):
    """Task: sums of the parts that each entry gets, and how many; one row per entry that gets any."""
    count, entries, d = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((count, entries, d), np.int64), np.zeros((count, entries), np.int64)
        for b in slices(batches, ROWS):
            pos, weight, parts = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(1))
            for p in np.unique(pos):
                own = np.flatnonzero(pos == p)
                ordered, place = _distinct(parts[own])
                entry = nearest(ordered, books[p])[0][place]
                np.add.at(total[p], entry, parts[own] * weight[own, None])
                np.add.at(many[p], entry, weight[own])
        p, e = np.nonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(many[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                                         names=["pos", "entry", "many", "total"])

    return task


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (position, entry, dimension) of whole_vectors(): they start as the parts of the first vectors by vec_id
    (nulls last, then by vector), fewer if there are fewer. Rounds of assignment and floor(sum / count) follow; entries that get nothing stay.

    The driver gets the codebooks alone: entries times dimensions, whatever the table's size."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64)
    books = np.stack(np.split(start, PARTS, axis=1)) if len(start) else np.zeros((PARTS, 0, 0), np.int64)
    if not len(start):
        return books
    parts = distinct_parts(vectors)
    for _ in range(rounds):
        sums = parts.mapInArrow(_sums(books), "pos int, entry int, many long, total array<long>")
        added = sums.groupBy("pos", "entry").agg(F.sum("many").alias("many"), F.array(*[F.sum(F.col("total")[j]) for j in range(books.shape[2])]).alias("total"))
        books = books.copy()
        for r in added.collect():
            books[r.pos, r.entry] = np.array(r.total, np.int64) // r.many
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (entries in order of the parts, two hex digits each, more where there are over 256 entries) and error
    (squared distances to them, summed). Each task makes the trie of the vectors it holds; no shuffle."""
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            whole = _matrix(b.column(2))
            code, error = np.zeros((len(whole), PARTS), np.int64), np.zeros(len(whole), np.int64)
            for p, part in enumerate(np.split(whole, PARTS, axis=1)):
                ordered, place = _distinct(part)
                entry, distance = nearest(ordered, books[p])
                code[:, p] = entry[place]
                error += distance[place]
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return vectors.select("vec_id", "label", "v").mapInArrow(task, schema)


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded and `decoded`: the entries that a code stands for, as components of a vector (array<double>)."""
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))
    width = books.shape[2]
    # PARTS x entries x dimensions numbers, bounded by the codebooks
    table = [F.array(*[F.array(*[F.lit(int(x) / SCALE) for x in e]) for e in book]) for book in books]
    picked = [F.get(table[p], F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int")) for p in range(PARTS)] if width else [F.array().cast("array<double>")]
    return coded.withColumn("decoded", F.concat(*picked))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """rows (vec_id, embedding, label) -> encode() of them, stored, and the codebooks."""
    vectors = whole_vectors(rows)
    books = train(vectors)
    return stored(encode(vectors, books), "vector-codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded and label_error: errors added up over equal labels, nulls together. Summed on the map side, and joined back, so that
    no task gets all rows of a label."""
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(per, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
