"""Byte-level BPE encoding and decoding, by recursive DuckDB queries in each partition.

A partition's texts are cut by the pre-tokenizer's pattern. Its distinct words become token-position rows, one row per byte. A
recursive query joins neighbours with the merge table, and each round contracts each word's leftmost pair of
the smallest rank, until no pair of any word can be merged. Words that are through are looked up for the
rest of the partition. Decoding joins the ids of a text with the vocabulary and puts the pieces together in order.

A long word needs as many rounds as it has merges, each over the whole word. It is cut into chunks that overlap, and the chunks'
tokens are put together where two neighbours agree on a token. This gives the word's own ids: tokens are those
of a text exactly if each two that follow each other are those of the two alone. For, as long as no merge crosses a
border of tokens, what happens inside of two neighbours is what happens to them alone, so the first merge that crosses one would cross it there too.
Neighbours inside of a chunk pass by that rule, and where chunks agree on a token each pair of neighbours lies in one of them.
Where they agree on none, chunks and overlaps are doubled, in the end to the whole word."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept for look-up by a task; beyond that the table starts anew.
KEPT_WORDS = 250_000
#: Words' bytes, and ids, that one query gets.
QUERY_BYTES, QUERY_IDS = 1 << 18, 1 << 18
#: Longer words run apart from the others, as they need as many rounds as they have bytes, at worst.
SHORT = 32
#: Words of more than two laps are cut into chunks of two laps; each chunk shares one with the next.
LAP = 64
#: Squared lengths of the words that one query gets, which bound the list entries of all of its rounds.
QUERY_SQUARES = 1 << 23
MEMORY = "200MB"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


ROUNDS = """
WITH RECURSIVE t(w, toks, live) AS (
    SELECT w, list(tok ORDER BY pos), true FROM start GROUP BY w
    UNION ALL (
    WITH pairs AS (
        SELECT w, unnest(range(1, len(toks))) AS pos, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS second
        FROM t WHERE live AND len(toks) > 1),
    best AS (
        SELECT w, min(rank * 4294967296 + pos) AS least FROM pairs JOIN merges ON tok = merges.a AND second = merges.b
        GROUP BY w),
    chosen AS (SELECT w, least // 4294967296 AS rank, least % 4294967296 AS pos FROM best)
    SELECT t.w, CASE WHEN pos IS NULL THEN toks ELSE toks[:pos - 1] || [rank] || toks[pos + 2:] END, pos IS NOT NULL
    FROM t LEFT JOIN chosen USING (w) WHERE live))
SELECT w, toks AS ids FROM t WHERE NOT live ORDER BY w"""

# The same for a chunk beyond QUERY_SQUARES: only the last round's list of a word is kept, at more time a round.
LONG_ROUNDS = ROUNDS.replace("t(w, toks, live) AS", "t(w, toks, live) USING KEY (w) AS").replace("UNION ALL", "UNION")

PIECES = """
SELECT d, string_agg(piece, '' ORDER BY pos) AS text
FROM ids JOIN vocabulary USING (tok) GROUP BY d ORDER BY d"""


class Codec:
    """An in-memory DuckDB with the merge table and the vocabulary, used by one task at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = [len(p) for p in ranks]
        merges = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        a, b, r = (pa.array(c, pa.int64()) for c in zip(*merges, strict=True))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", pa.table({"a": a, "b": b, "rank": r}))
        # bytes as the characters of the same numbers, so that pieces can be put together as text
        self._table("vocabulary", pa.table({"tok": pa.array(ranks.values(), pa.int64()), "piece": [p.decode("latin-1") for p in ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, words: list[bytes], rounds: str) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        w = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        self.db.register("start", pa.table({"w": w, "pos": pos, "tok": self.byte_rank[np.frombuffer(b"".join(words), np.uint8)]}))
        ids = self.db.sql(rounds).to_arrow_table()["ids"].combine_chunks()
        self.db.unregister("start")
        flat, at = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]

    def _contract(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, by queries that each get a bounded number of bytes and squares, or one word."""
        out: dict[bytes, bytes] = {}
        group: list[bytes] = []
        size = squares = 0
        for w in [*sorted(words, key=lambda w: (len(w) > SHORT, w)), b""]:
            n = len(w)
            if group and (not w or size + n > QUERY_BYTES or squares + n * n > QUERY_SQUARES or (n > SHORT) != (len(group[0]) > SHORT)):
                out.update(zip(group, self._query(group, ROUNDS if squares <= QUERY_SQUARES else LONG_ROUNDS), strict=True))
                group, size, squares = [], 0, 0
            group.append(w)
            size, squares = size + n, squares + n * n
        return out

    def _contract_long(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words of more than two laps, from those of their chunks."""
        out: dict[bytes, bytes] = {}
        lap = LAP
        while words:
            cut = {w: [w[s: s + 2 * lap] for s in range(0, max(len(w) - lap, 1), lap)] for w in words}
            ids = self._contract({c for chunks in cut.values() for c in chunks})
            for w, chunks in cut.items():
                joined = self._joined([np.frombuffer(ids[c], "<u4") for c in chunks], lap)
                if joined is not None:
                    out[w] = joined
            words = words - out.keys()
            lap *= 2
        return out

    def _joined(self, chunks: list[np.ndarray], lap: int) -> bytes | None:
        """The ids of neighbouring chunks put together, each from the first token that it shares with the one before."""
        parts = []
        before, starts = chunks[0], np.cumsum(self.length[chunks[0]]) - self.length[chunks[0]]
        for i, after in enumerate(chunks[1:], 1):
            begins = i * lap + np.cumsum(self.length[after]) - self.length[after]
            shared, a, b = np.intersect1d(starts, begins, assume_unique=True, return_indices=True)
            same = np.flatnonzero(before[a] == after[b])
            if not len(same):
                return None
            first = same[0]
            parts.append(before[: a[first]])
            before, starts = after[b[first]:], begins[b[first]:]
        return b"".join(p.tobytes() for p in [*parts, before])

    def _learn(self, new: set[str]) -> None:
        coded = {w: w.encode() for w in new}
        ids = self._contract({c for c in coded.values() if len(c) <= 2 * LAP})
        ids |= self._contract_long({c for c in coded.values() if len(c) > 2 * LAP})
        self.words.update((w, ids[c]) for w, c in coded.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        cut = [self.find(t) for t in texts]
        new = {w for words in cut for w in words if w not in self.words}
        if new:
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids. Long lists go in parts, which are put together as they come."""
        out = [b""] * len(encoded)
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for d, code in enumerate(encoded):
            ids = np.frombuffer(code, "<u4")
            for i in range(0, len(ids), QUERY_IDS):
                part = ids[i: i + QUERY_IDS]
                if size + len(part) > QUERY_IDS:
                    self._join(group, out)
                    group, size = [], 0
                group.append((d, part))
                size += len(part)
        self._join(group, out)
        return out

    def _join(self, group: list[tuple[int, np.ndarray]], out: list[bytes]) -> None:
        if not group:
            return
        lengths = [len(p) for _, p in group]
        self.db.register("ids", pa.table({"d": np.repeat(np.arange(len(group)), lengths), "pos": np.arange(sum(lengths)),
                                          "tok": np.concatenate([p for _, p in group]).astype(np.int64)}))
        for d, text in self.db.execute(PIECES).fetchall():
            out[group[d][0]] += text.encode("latin-1")
        self.db.unregister("ids")


@contextmanager
def _codec(ranks: dict[bytes, int], pattern: str) -> Iterator[Codec]:
    """One per task: its words and tables go when the task ends, as the worker goes on to others."""
    codec = Codec(ranks, pattern)
    try:
        yield codec
    finally:
        codec.words.clear()
        codec.db.close()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, text -> doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens.

    Whole texts, a null is empty; no special tokens. The vocabulary is a file of the cluster's Python, 50,000 lines; it
    is read once by the driver and broadcast. Other columns are not looked at."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(ranks.value, pattern) as codec:
            for b in slices(batches):
                ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens -> the same and decoded (binary). Null ids decode to nothing."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(ranks.value, public_tokenizers.PATTERN) as codec:
            for b in slices(batches):
                text = codec.decode([x or b"" for x in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(task, "doc_id long, ids binary, n_tokens long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encode_documents() and decode_documents() in one task: doc_id, ids, n_tokens, decoded."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(VOCABULARY)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(ranks.value, pattern) as codec:
            for b in slices(batches):
                ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(codec.decode(ids), pa.binary())],
                                                 names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids binary, n_tokens long, decoded binary")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding docs."""
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
