"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

1. Each partition of rows (a sender) cuts the hashes of its texts to fingerprints, sorts them, and sends each
   owner of a range the sorted gaps, Golomb-Rice coded: about log2(range / count) + 1.5 bits each.
2. An owner decodes the lists of all senders and answers each with a bitmap of what others have sent, too.
3. Only rows whose fingerprint is marked, by others or by a repeat inside the partition, are suspects. Their
   texts meet and are compared byte by byte; all others are single without having been moved."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import lower_ascii, stored, whole_row

#: Bits beyond log2(rows): one in 2**EXTRA_BITS single texts is suspected, and cleared by its bytes.
EXTRA_BITS = 10
#: Fingerprints an owner holds at once, about.
PER_OWNER = 1 << 19
LIST = "owner int, part long, n int, k int, unary binary, low binary, own binary"


def rice_encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Sorted distinct whole numbers -> gaps over 2**k in unary, and their low k bits."""
    gaps = np.diff(values, prepend=0)
    high = gaps >> k
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return np.packbits(unary).tobytes(), np.packbits(low).tobytes()


def rice_decode(unary: bytes, low: bytes, n: int, k: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum((high.astype(np.int64) << k) + bits @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64)))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _send(width: int):
    """width: fingerprints per owner's range."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not got:
            return
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        owners = values // width
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1, [len(values)]))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = values[a:b] % width
            k = max(1, int(math.log2(max(2.0, 0.69 * width / len(mine)))))
            unary, low = rice_encode(mine, k)
            rows.append((int(owners[a]), TaskContext.get().partitionId(), len(mine), k, unary, low, _bits(counts[a:b] > 1)))
        columns = list(zip(*rows, strict=True))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in LIST.split(", ")])
    return task


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """What an owner sends back: for each sender, which of its fingerprints another one has, too."""
    decoded = [rice_decode(r.unary, r.low, r.n, r.k) for r in lists.itertuples()]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    twice = values[counts > 1]
    marks = [_bits(np.isin(d, twice)) for d in decoded]
    return pd.DataFrame({"part": lists["part"], "owner": lists["owner"], "marks": marks})


def _suspects(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, np.int64)]
            for r in b.to_pylist():
                flags = _flags(r["own"], r["n"]) | _flags(r["marks"], r["n"])
                found.append(rice_decode(r["unary"], r["low"], r["n"], r["k"])[flags] + r["owner"] * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["fp"])
    return task


def suspects(fingerprints: DataFrame, bits: int, rows: int) -> DataFrame:
    """fp (long, below 2**bits) -> the fingerprints that occur more than once, each once."""
    owners = max(16, -(-rows // PER_OWNER))
    width = -(-(1 << bits) // owners)
    lists = stored(fingerprints.select("fp").mapInArrow(_send(width), LIST), "golomb")
    marks = lists.select("owner", "part", "n", "k", "unary", "low").groupBy("owner").applyInPandas(_answer, "part long, owner int, marks binary")
    return lists.join(marks, ["part", "owner"]).select("owner", "n", "k", "unary", "low", "own", "marks").mapInArrow(_suspects(width), "fp long").distinct()


def _prepared(docs: DataFrame) -> DataFrame:
    norm = lower_ascii(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", whole_row(docs).alias("_row"), norm.alias("_norm")).withColumn("_sha", F.sha2("_norm", 256)).withColumn("_hash", F.xxhash64("_norm"))


class ExactDedup:
    """The groups of equal texts of docs (doc_id, text), after lower-casing A-Z; null counts as empty.

    Of equal texts, the row with the largest doc_id stays; a null id is below all others; of rows with equal
    text and id, one stays. Other columns are carried and not looked at. Texts of any length are whole."""

    def __init__(self, docs: DataFrame):
        self.base = _prepared(docs)
        light = stored(self.base.select("doc_id", "_sha", "_hash"), "hashes")
        rows = light.count()
        self.bits = min(62, max(1, rows - 1).bit_length() + EXTRA_BITS)
        cut = F.shiftrightunsigned("_hash", 64 - self.bits)
        self.light, self.base = light.withColumn("_fp", cut), self.base.withColumn("_fp", cut)
        self.suspects = stored(suspects(self.light.select(F.col("_fp").alias("fp")), self.bits, rows).select(F.col("fp").alias("_fp")), "suspects")
        # the bytes decide: one row per text, copies are counted before they are moved
        same = self.base.join(self.suspects, "_fp").groupBy("_norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        self.groups = stored(same.select(F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size"), "groups")

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
        units = self.light.groupBy("doc_id", "_sha").agg(F.count("*").alias("_m"))
        joined = units.join(self.groups, "_sha", "left")
        nth = joined.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
        single = F.col("group_size").isNull()
        return nth.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                          F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                          (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1))).alias("kept"),
                          F.col("_sha").alias("text_sha256"))

    def kept(self) -> DataFrame:
        """The rows of docs that stay, with all their columns."""
        single = self.base.join(self.suspects, "_fp", "left_anti")
        best = self.base.join(self.suspects, "_fp").join(self.groups.select("_sha", F.col("keep_id").alias("_keep")), "_sha")
        best = best.where(F.col("doc_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
        return single.select("_row").unionByName(best.select("_row")).select("_row.*")
