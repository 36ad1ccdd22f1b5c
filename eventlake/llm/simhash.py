"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in three bits at most differ in one bit at most
in one of the halves. So each fingerprint is filed under both of its halves, and looks into all halves of the Hamming
ball of radius one (flips of zeros suffice: of two halves that differ in one bit, one has the zero). What meets
under a half is compared in full. Equal fingerprints are one node. A half under which very many meet is cut into
cells, each a block against a block; a cell gives the components it finds, not its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import TO_LOWER, byte_view, slices, sorted_runs, stored, whole_row
from eventlake.llm.components import components

SHINGLE = 3
MAX_BITS = 3
CELL = 4096
#: Fingerprint bits summed at a time: bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of the word shingles of a lower-cased text; zero without words."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i: i + CHUNK]
        set_in += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        flat, at = byte_view(b.column(2))
        lower = TO_LOWER[flat].tobytes()
        out = np.array([fingerprint(lower[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text_hash, fp (the 64 bits as a long), one row per row."""
    return docs.select("doc_id", _text_hash().alias("h"), "text").mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def cell_components(link: np.ndarray) -> np.ndarray:
    """For a boolean matrix of links between rows and columns: a component number per row and column, -1 for none."""
    rows, cols = link.shape
    of_row, of_col = np.full(rows, -1), np.full(cols, -1)
    for start in np.flatnonzero(link.any(axis=1)):
        if of_row[start] >= 0:
            continue
        new_rows = np.array([start])
        of_row[start] = start
        while len(new_rows):
            reach = link[new_rows].any(axis=0) & (of_col < 0)
            of_col[reach] = start
            more = link[:, reach].any(axis=1) & (of_row < 0)
            of_row[more] = start
            new_rows = np.flatnonzero(more)
    return np.concatenate((of_row, of_col))


def _cell_links(max_bits: int):
    """Rows (key, cell, fp, side), sorted by key and cell -> edges of the components found in each cell."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_runs(batches, ["key", "cell"]):
            fp = table["fp"].to_numpy().view(np.uint64)
            left = table["side"].to_numpy() == 0
            lefts = np.concatenate(([0], np.cumsum(left)))
            n_left = lefts[bounds[1:]] - lefts[bounds[:-1]]
            # alone, a fingerprint meets itself
            size = np.diff(bounds)
            itself = (size == 2) & (fp[bounds[:-1]] == fp[bounds[1:] - 1])
            busy = np.flatnonzero((n_left > 0) & (n_left < size) & ~itself)
            edges: list[np.ndarray] = []
            for r in busy:
                run = slice(bounds[r], bounds[r + 1])
                a = np.unique(fp[run][left[run]])
                b = np.unique(fp[run][~left[run]])
                link = np.empty((len(a), len(b)), bool)
                for i in range(0, len(a), 256):
                    link[i: i + 256] = np.bitwise_count(a[i: i + 256, None] ^ b[None, :]) <= max_bits
                number = cell_components(link)
                nodes = np.concatenate((a, b))
                keep = number >= 0
                edges.append(np.stack((nodes[keep], a[number[keep]]), axis=1))
            if edges:
                all_of = np.concatenate(edges).view(np.int64)
                all_of = np.unique(all_of[all_of[:, 0] != all_of[:, 1]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(all_of[:, 0]), pa.array(all_of[:, 1])], names=["a", "b"])
    return task


def linked(nodes: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """fp (long, distinct) -> edges (a, b) that connect what links of max_bits (3 at most) connect."""
    if max_bits > 3:
        raise ValueError("two halves with balls of radius one find three differing bits at most")
    halves = nodes.select("fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("no", "half"))
    tag = F.shiftleft(F.col("no").cast("long"), 32)
    zeros = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("half").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0)
    ball = F.transform(zeros, lambda i: F.struct((tag + F.col("half") + F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("key"), F.lit(1).alias("side")))
    own = F.array(F.struct((tag + F.col("half")).alias("key"), F.lit(0).alias("side")), F.struct((tag + F.col("half")).alias("key"), F.lit(1).alias("side")))
    entries = halves.select("fp", F.inline(F.concat(own, ball)))
    crowded = stored(entries.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("side") == 0, 1)).alias("own")).where(F.col("own").isNotNull() & (F.col("n") > cell))
                     .select("key", F.ceil(F.col("n") / cell).cast("int").alias("_blocks")), "crowded")
    # a crowded key is a square of cells: a block of the filed against a block of those that look it up
    placed = entries.join(crowded, "key", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.when(F.col("side") == 0, block * F.col("_blocks") + i).otherwise(i * F.col("_blocks") + block))
    spread = placed.select("key", F.explode(cells).alias("cell"), "fp", "side")
    return spread.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_cell_links(max_bits), "a long, b long").distinct()


class SimHashDedup:
    """Documents (doc_id, text) linked by fingerprints that differ in few bits.

    Null texts and texts without words have fingerprint zero. A component's id is its smallest doc_id; nulls
    are passed over, and the id is null if there is no other. Other columns are not looked at."""

    def __init__(self, docs: DataFrame, max_bits: int = MAX_BITS):
        self.docs = docs
        self.prints = stored(fingerprints(docs), "fingerprints")
        nodes = stored(self.prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
        found = stored(linked(nodes.select("fp"), max_bits), "links")
        roots = components(found)
        placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        self.nodes = stored(placed.join(lowest, "root").select("fp", "first", "root", "component_id"), "components")

    def members(self) -> DataFrame:
        """doc_id, fp, component_id: one row per document."""
        return self.prints.join(self.nodes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

    def kept(self) -> DataFrame:
        """One document of each component, with all its columns: the one whose id the component has. Of several rows
        with that id, the one with the smallest fingerprint stays."""
        ids = self.prints.join(self.nodes.select("fp", "root", "component_id"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        best = ids.groupBy("root").agg(F.min(F.struct("fp", "text_hash", "doc_id")).alias("b")).select(F.col("b.doc_id").alias("_d"), F.col("b.text_hash").alias("_h"))
        rows = self.docs.select("doc_id", _text_hash().alias("_t"), whole_row(self.docs).alias("_row"))
        rows = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")))
        return rows.dropDuplicates(["_d", "_h"]).select("_row.*")
