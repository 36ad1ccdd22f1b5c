"""Quality classifier: supervised subword embeddings.

Features of a text are hashed: its words (case tells quality and stays), the byte 3-, 4- and 5-grams of its words with their borders, and whether a word repeats the
one before. Each feature has a learned vector; a document is the mean of its features' vectors; a softmax over
that gives the classes. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents. As mean and output are linear, a learned feature is in the end one number per class, so scoring whole texts is
look-ups and sums over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import BYTE_VALUES, byte_view, mix64, range_hashes, slices, word_spans

BUCKETS_LOG2 = 17
DIMENSIONS = 12
#: Steps of gradient descent, over as many epochs as that takes.
STEPS = 12_000
RATE = 0.5
#: Labelled documents for training, at most: the bound of what reaches the driver.
SAMPLE = 3000
GRAMS = (3, 4, 5)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """weights: for each bucket the difference of the two classes' scores; bias likewise."""
    weights: np.ndarray
    bias: float


def features(flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of the rows of byte_view(), by kind: (row number, bucket) each in ascending order of rows."""
    shift = np.uint64(64 - BUCKETS_LOG2)
    starts, ends, before = word_spans(flat, at)
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(before))
    values = BYTE_VALUES[flat]
    words = range_hashes(values, starts, ends, 1)
    yield rows, (words >> shift).astype(np.int64)
    again = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
    yield rows[again], np.zeros(len(again), np.int64)
    # n-grams of ' word ': the border is a space whatever stands there
    lengths = ends - starts + 2
    edge = np.cumsum(lengths)
    padded = np.full(int(edge[-1]) if len(edge) else 0, BYTE_VALUES[32])
    inside = np.ones(len(padded), bool)
    inside[edge - 1] = False
    inside[edge - lengths] = False
    word_bytes = np.zeros(len(flat), np.int32)
    np.add.at(word_bytes, starts, 1)
    closed = np.zeros(len(flat) + 1, np.int32)
    np.add.at(closed, ends, 1)
    padded[inside] = values[np.cumsum(word_bytes - closed[:-1]) > 0]
    row_of = np.repeat(rows, lengths)
    last = np.repeat(edge, lengths)
    for n in GRAMS:
        if len(padded) < n:
            continue
        gram = np.zeros(len(padded) - n + 1, np.uint64)
        for j in range(n):
            gram = gram * np.uint64(0x100000001B3) + padded[j: len(padded) - n + 1 + j]
        fits = np.flatnonzero(np.arange(len(gram)) + n <= last[: len(gram)])
        yield row_of[fits], (mix64(gram[fits] + np.uint64(n)) >> shift).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> label and the text's buckets with their counts."""
    for b in batches:
        for i in range(b.num_rows):
            flat, at = byte_view(b.column(1).slice(i, 1))
            got = [x for _, x in features(flat, at)]
            bucket, count = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([bucket.astype("<i4").tobytes()]), pa.array([count.astype("<i4").tobytes()])], names=["label", "bucket", "count"])


def train(labelled: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """labelled: (0 or 1, buckets, counts). Without rows of both labels, all scores are the share of label 1, or a half."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKETS_LOG2
    ones = sum(y for y, _, _ in labelled)
    if ones in (0, len(labelled)):
        share = (ones + 1) / (len(labelled) + 2)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    step = 0
    while step < STEPS:
        for i in rng.permutation(len(labelled))[: STEPS - step]:
            y, bucket, count = labelled[i]
            rate = np.float32(RATE * (1 - step / STEPS))
            step += 1
            total = max(1, count.sum())
            share = (count / total).astype(np.float32)
            mean = share @ vectors[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            # as if each feature occurrence took its own step of the document's mean
            vectors[bucket] -= (rate * share * np.float32(min(total, 20)))[:, None] * back[None, :]
    weights = vectors @ (out[:, 1] - out[:, 0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0, 1; others are left out). Fitted on the `sample` labelled documents whose ids hash
    lowest. Only they are looked up in docs, and only their feature counts reach the driver."""
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers, so a broadcast is safe
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("label", F.coalesce("text", F.lit("")).alias("text"))
    rows = known.mapInArrow(_counts, "label int, bucket binary, count binary").collect()
    data = [(r.label, np.frombuffer(r.bucket, "<i4").astype(np.int64), np.frombuffer(r["count"], "<i4")) for r in rows]
    data.sort(key=lambda d: (len(d[1]), d[0], d[1].tobytes(), d[2].tobytes()))
    return train(data)


def score_texts(model: Model, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    sums, counts = np.zeros(n), np.zeros(n)
    for row, bucket in features(flat, at):
        sums += np.bincount(row, model.weights[bucket], n)
        counts += np.bincount(row, minlength=n)
    return 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + model.bias)))


#: Bytes of text whose features are held at once.
BYTES_AT_ONCE = 1 << 18


def score_column(model: Model, texts: pa.Array) -> np.ndarray:
    flat, at = byte_view(texts)
    out, i = [np.empty(0)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BYTES_AT_ONCE, "right")) - 1)
        out.append(score_texts(model, flat[at[i]: at[j]], at[i: j + 1] - at[i]))
        i = j
    return np.concatenate(out)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs (doc_id, text). Null texts count as empty, and an empty
    text has the score of the bias. Whole texts; other columns are not looked at."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(weights.value, b.column(1)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns labels.quality of all rows but the held-out ones."""
    return fit(docs, labels.where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label")), sample)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(score_column(weights.value, b.column(text)) >= threshold))

    return docs.mapInArrow(task, docs.schema)
