"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation of the principal components is learned such that the signs of the rotated vectors lose as little as possible
(a balanced binary code). The code is cut into segments, one table each. Every vector is filed in each table under all
values of the Hamming ball of radius one around its segment, so two vectors meet if a segment differs in
two bits at most. Segments grow with the logarithm of the number of vectors, which keeps tables sparse, and tables are added
until pairs made at the threshold are met with the wanted chance. Those that meet and are near by their whole codes
are compared by their vectors in double precision. A pair that meets in several places is counted in one of them.
Equal vectors are one node. A crowded place is cut into cells of a block against a block, and a
cell gives sums and the components it finds, not its pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import sorted_runs, stored
from eventlake.llm.components import components
from eventlake.llm.simhash import cell_components

THRESHOLD = 0.9
RECALL = 0.97
#: Vectors the rotation is fitted on, at most. All vectors are indexed.
SAMPLE = 4096
CELL = 2048
RADIUS = 1
#: Tables that segments are shortened for, and tables at most (they are numbered by eight bits); made pairs at least.
TABLES, MOST_TABLES = 64, 255
PAIRS = 2000


@dataclass(frozen=True)
class Index:
    mean: np.ndarray
    projection: np.ndarray
    segment_bits: int
    tables: int
    max_bits: int
    #: share of made pairs at the threshold that meet
    recall: float = 1.0

    def segments(self, unit: np.ndarray) -> np.ndarray:
        """Unit vectors -> their code's segments, one column per table."""
        bits = (unit - self.mean) @ self.projection > 0
        weights = 1 << np.arange(self.segment_bits, dtype=np.int64)
        return bits.reshape(len(unit), self.tables, self.segment_bits) @ weights


def itq(vectors: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """Centred vectors -> projection to `bits` numbers whose signs are the code."""
    _, _, axes = np.linalg.svd(vectors, full_matrices=False)
    axes = axes[:bits]
    low = np.zeros((len(vectors), bits))
    low[:, : len(axes)] = vectors @ axes.T
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(low @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ low)
        turn = (u @ v).T
    return axes.T @ turn[: len(axes)]


def plan(rows: int, differs: float, recall: float) -> tuple[int, int]:
    """(segment bits, tables) for so many vectors, where a bit of two vectors at the threshold differs with a chance of `differs`.

    Segments have as many bits as keep places of the table short; where that would take more than TABLES tables, fewer."""
    bits = min(32, max(16, math.ceil(math.log2(max(2, rows)))))
    while True:
        meet = sum(math.comb(bits, d) * differs ** d * (1 - differs) ** (bits - d) for d in range(2 * RADIUS + 1))
        tables = max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 4
        if tables <= TABLES or bits <= 8:
            return bits, min(tables, MOST_TABLES)
        bits -= 1


def made_partners(unit: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another one at exactly the threshold, in a random direction."""
    other = rng.normal(size=unit.shape)
    other -= (other * unit).sum(axis=1)[:, None] * unit
    length = np.linalg.norm(other, axis=1)[:, None]
    pair = threshold * unit + math.sqrt(max(0.0, 1 - threshold ** 2)) * np.where(length > 1e-12, other / np.maximum(length, 1e-12), 0)
    return pair / np.linalg.norm(pair, axis=1)[:, None]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> Index:
    """sample: unit vectors. Codes longer than the vectors take further rotations.

    How often bits of near vectors differ is measured, on pairs made at the threshold of the half of the sample that the rotation is not fitted on: codes are signs of vectors less
    their mean, and what vectors have in common widens the angle that is left. Tables are added until the pairs meet as often
    as wanted; the most differing bits of a code are four deviations above what the pairs have."""
    rng = np.random.default_rng(seed)
    learned, base = (sample[::2], sample[1::2]) if len(sample) > 1 else (sample, sample)
    mean = learned.mean(axis=0)
    base = base[np.arange(max(PAIRS, len(base))) % len(base)]
    pairs = base, made_partners(base, threshold, rng)
    width = sample.shape[1]
    rotations: list[np.ndarray] = []

    def differing(first: int, last: int) -> np.ndarray:
        """Which bits first to last of the pairs' codes differ."""
        while len(rotations) * width < last:
            rotations.append(itq(learned - mean, width, rng))
        turn = np.concatenate(rotations[first // width: -(-last // width)], axis=1)[:, first - first // width * width:][:, : last - first]
        return ((pairs[0] - mean) @ turn > 0) != ((pairs[1] - mean) @ turn > 0)

    bits, tables = plan(rows, float(differing(0, max(width, 32)).mean()), recall)
    met, apart, done = np.zeros(len(base), bool), np.zeros(len(base), np.int64), 0
    while True:
        for t in range(done, tables):
            d = differing(t * bits, (t + 1) * bits).sum(axis=1)
            met |= d <= 2 * RADIUS
            apart += d
        done = tables
        if met.mean() >= recall or tables >= MOST_TABLES:
            break
        tables = min(MOST_TABLES, tables + max(1, tables // 8))
    most = math.ceil(apart.mean() + 4 * apart.std())
    found = float((met & (apart <= most)).mean())
    return Index(mean, np.concatenate(rotations, axis=1)[:, : bits * tables], bits, tables, most, found)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy()
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _canonical(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one value of those that two segments' balls share under which the pair counts."""
    x = a ^ b
    low = x & -x
    return np.where(x == low, np.minimum(a, b), np.minimum(a ^ low, a ^ (x ^ low)))


def _meeting(seg: np.ndarray, value: int, table: int, max_bits: int, blk: np.ndarray, square: bool) -> np.ndarray:
    """Which pairs of a run's rows count here and are near by their codes: upper triangle."""
    n = len(seg)
    near = np.triu(np.ones((n, n), bool), 1)
    if not square:
        near &= blk[:, None] != blk[None, :]
    total = np.zeros((n, n), np.int32)
    for t in range(seg.shape[1]):
        d = np.bitwise_count(seg[:, None, t] ^ seg[None, :, t]).astype(np.int32)
        total += d
        if t < table:
            near &= d > 2 * RADIUS
        elif t == table:
            near &= d <= 2 * RADIUS
    near &= total <= max_bits
    i, j = np.nonzero(near)
    near[i, j] = _canonical(seg[i, table], seg[j, table]) == value
    return near


def _runs(table: pa.Table, bounds: np.ndarray, tables: int) -> Iterator[tuple[slice, np.ndarray]]:
    seg = table["seg"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
    for r in np.flatnonzero(np.diff(bounds) > 1):
        yield slice(int(bounds[r]), int(bounds[r + 1])), seg


def _near_runs(index: Index):
    """Keeps of each run the rows that meet another one near by code."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_runs(batches, ["key", "cell"]):
            key, blk = table["key"].to_numpy(), table["blk"].to_numpy()
            corner = table["cell"].to_numpy() % (table["blocks"].to_numpy() + 1) == 0
            keep = np.zeros(table.num_rows, bool)
            for run, seg in _runs(table, bounds, index.tables):
                k = int(key[run.start])
                near = _meeting(seg[run], k & ((1 << index.segment_bits) - 1), k >> index.segment_bits & 0xFF, index.max_bits, blk[run], bool(corner[run.start]))
                keep[run] = near.any(axis=0) | near.any(axis=1)
            yield from table.filter(pa.array(keep)).select(["key", "cell", "blk", "blocks", "node"]).to_batches()
    return task


def _link_runs(index: Index, threshold: float):
    """Rows with vectors, by run -> for each row its links here (copies counted) and the smallest row of its component here."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in sorted_runs(batches, ["key", "cell"]):
            key, blk = table["key"].to_numpy(), table["blk"].to_numpy()
            corner = table["cell"].to_numpy() % (table["blocks"].to_numpy() + 1) == 0
            node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
            unit = unit_rows(_matrix(table["vector"], index.mean.shape[0]))
            out = []
            for run, seg in _runs(table, bounds, index.tables):
                k = int(key[run.start])
                near = _meeting(seg[run], k & ((1 << index.segment_bits) - 1), k >> index.segment_bits & 0xFF, index.max_bits, blk[run], bool(corner[run.start]))
                near &= unit[run] @ unit[run].T >= threshold
                near |= near.T
                has = near.any(axis=1)
                if has.any():
                    links = near @ copies[run]
                    # rows and columns are the same nodes
                    root = cell_components(near | np.diag(has))[: len(near)]
                    out.append(np.stack((node[run][has], node[run][root[has]], links[has]), axis=1))
            if out:
                a = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, i]) for i in range(3)], names=["node", "root", "links"])
    return task


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """vec_id, embedding (array of numbers) -> vec_id, n_links, component_id, kept; one row per row.

    Links are pairs of a cosine of threshold or more, found with about the wanted recall at the threshold itself and more above it.
    Vectors that are null, empty, zero or hold nulls or numbers that are not finite link with nothing, nor do vectors of different
    lengths. Equal vectors are copies of one node and link with each other. Null ids count as vectors; a component's id is its smallest id. An empty table gives no rows."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = rows.where(usable(F.col("vector")))
    grouped = fine.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    alone = rows.where(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size.n:
        return alone
    picked = nodes.orderBy(F.xxhash64("vector"), "node").limit(sample).select("vector").collect()
    known = np.zeros((len(picked), size.width))
    for i, r in enumerate(picked):
        known[i, : len(r.vector)] = r.vector
    index = fit(unit_rows(known), size.n, threshold, recall)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                seg = index.segments(unit_rows(_matrix(b.column(2), size.width)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(seg), pa.list_(pa.int64()))], names=["node", "length", "seg"])

    codes = stored(nodes.select("node", F.size("vector").alias("length"), "vector").mapInArrow(code, "node long, length int, seg array<long>"), "codes")
    width = index.segment_bits
    by_table = codes.select("node", "length", "seg", F.posexplode("seg").alias("t", "value"))
    tag = F.shiftleft(F.col("length").cast("long") * 256 + F.col("t"), width)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    entries = by_table.select("node", "seg", F.explode(F.transform(flips, lambda f: tag + F.col("value").bitwiseXOR(f))).alias("key"))
    crowded = stored(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("_blocks")), "crowded")
    placed = entries.join(crowded, "key", "left").withColumn("blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    square = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("blk", j) * F.col("blocks") + F.greatest(F.col("blk"), j))
    spread = placed.select("key", F.explode(square).alias("cell"), "blk", "blocks", "node", "seg")
    near = spread.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_near_runs(index), "key long, cell int, blk int, blocks int, node long")
    near = stored(near, "near")
    full = near.join(codes.select("node", "seg"), "node").join(nodes.select("node", "copies", "vector"), "node")
    found = stored(full.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
                   .mapInArrow(_link_runs(index, threshold), "node long, root long, links long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_n")
    joined = nodes.select("node", "vector", "first", "copies").join(links, "node", "left").join(roots, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(lowest, "root").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = fine.join(of, "vector").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
