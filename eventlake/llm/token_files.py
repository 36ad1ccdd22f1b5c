"""Token-ID files: binary shards of token ids in which each document is a zstandard frame of its own, all with one shared dictionary
that is trained on serialized id arrays. So a short document is found by the offset index and unpacked without its neighbours,
and still as small as if it were compressed with them.

`token_ids` is a Spark data source with a writer and a reader. A folder of it holds

    ids.dictionary      the shared dictionary, zstandard's own format; empty if there was too little to train on
    shard-PPPPP-T.ids   one per partition that has rows, in partition order
    shards.json         written last, by the commit: the shards that count, with their documents and ids

A shard is, little-endian: magic, bytes per id (u4), SHA-256 of the dictionary (32 bytes); the frames; the offset index, a
zstandard frame of five arrays, one item per document: doc_id (i8), 0 if the id is null (u1), offset of the frame (u8), its bytes (u4), ids
(u8); at the end the offset and the bytes of the index (u8, u4), the documents (u8) and the magic again.

A shard gets a name of its own from each attempt of a task, and only the commit says which ones count: what lost or repeated
attempts leave behind is never read. Tasks write through Arrow's file systems, so a folder may be local, HDFS or an object store."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from eventlake.llm.common import pieces
from eventlake.sources.files import arrow_location

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"TOKIDS1\n"
HEAD = struct.Struct("<8sI32s")
TAIL = struct.Struct("<QIQ8s")
LEVEL = 3
#: The dictionary is trained on about this many documents, without those of more bytes than this (it is there for short ones), and is of this size at most.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8192, 64 * 1024
#: Ids that reach Spark in one batch of the reader, at most, but for a longer document.
BATCH_IDS = 1 << 20
#: Bytes of text encoded at once, and words that a task keeps the ids of.
BYTES_AT_ONCE, KEPT_WORDS = 1 << 20, 500_000


# ---- encoding ----------------------------------------------------------------------------------

# The rules of the vocabulary file for which the short way of WordEncoder holds.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Words of printable ASCII and the letters of Latin-1, and how the rules cut them once they are lower-cased.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
PARTS_AT_ONCE = 1000


class _Numbers(dict):
    """Numbers things in the order they come."""

    def __missing__(self, thing):
        self[thing] = number = len(self)
        return number

    def since(self, number: int) -> list:
        return list(itertools.islice(reversed(self), len(self) - number))[::-1]


class _Lists:
    """Lists of ids by number."""

    def __init__(self):
        self.flat, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after another, and the length of each."""
        begin = self.start[which]
        many = self.start[which + 1] - begin
        upto = np.cumsum(many)
        return self.flat[np.repeat(begin - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)], many


class WordEncoder:
    """Encodes texts by way of their different words, and words by way of their different parts; the library encodes each part once.

    With the rules of the vocabulary file this gives what the library gives for the whole text: they work within words between
    ASCII white space (no match holds white space, no letter composes with it, no special token holds any), and within a plain
    word they cut as PARTS does and the model sees each part alone. Words with other characters or a special token go to the
    library whole. With other rules, whole texts go to it."""

    def __init__(self, tokenizer: Tokenizer, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        told = json.loads(tokenizer.to_str())
        self.tokenizer, self.end_id = tokenizer, end_id
        self.by_words = {k: told.get(k) for k in RULES} == RULES
        special = [t["content"] for t in told.get("added_tokens") or ()]
        self.by_words &= all(t.split() == [t] for t in special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.of_part = Tokenizer(tokenizer.model)
        self.of_part.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = _Numbers({b" ": 0}), _Lists()
        self.ids.add(np.array([self.end_id]), np.array([1]))  # number 0 is the end of a text
        self.parts, self.part_ids = _Numbers({"\n": 0}), _Lists()
        self.part_ids.add(np.empty(0), np.array([0]))

    def _learn(self, new: list[bytes]) -> None:
        """Gives the new words their lists of ids. All of them are cut at once: line ends, as part 0, keep them apart."""
        words = b"\n".join(new).decode().split("\n")
        odd = {i for i, w in enumerate(words) if not PLAIN.fullmatch(w) or (self.special and self.special.search(w))}
        plain = "\n".join([w for i, w in enumerate(words) if i not in odd] if odd else words).lower()
        known = len(self.parts)
        part = np.fromiter(map(self.parts.__getitem__, PARTS.findall(plain)), np.int64)
        fresh = self.parts.since(known)
        for i in range(0, len(fresh), PARTS_AT_ONCE):
            some = fresh[i: i + PARTS_AT_ONCE]
            e = self.of_part.encode(" ".join(some), add_special_tokens=False)
            self.part_ids.add(np.array(e.ids), np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
        ends = np.append(np.flatnonzero(part == 0), len(part))
        flat, many = self.part_ids.get(part)
        upto = np.append(0, np.cumsum(many))[ends]
        lists = _Lists()
        if len(words) > len(odd):
            lists.add(flat, np.diff(upto, prepend=0))
        if odd:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in sorted(odd)], add_special_tokens=False)]
            lists.add(np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64))
        is_odd = np.zeros(len(words), bool)
        is_odd[list(odd)] = True
        place = np.where(is_odd, len(words) - len(odd) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
        self.ids.add(*lists.get(place))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and the offsets of the texts in them."""
        if not self.by_words:
            got = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.cumsum([0, *map(len, got)])
        if len(self.words) > KEPT_WORDS:
            self._forget()
        known = len(self.words)
        cut = [[*t.split(), b" "] for t in texts]
        word = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
        if len(self.words) > known:
            self._learn(self.words.since(known))
        ids, many = self.ids.get(word)
        return ids, np.append(0, np.append(0, np.cumsum(many))[np.cumsum([len(w) for w in cut])]) if cut else np.zeros(1, np.int64)


#: One per vocabulary and Python worker, which goes on to other tasks with the words it knows; what it keeps is bounded by KEPT_WORDS.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def _encoder(vocabulary: str, end_id: int) -> WordEncoder:
    if (vocabulary, end_id) not in _ENCODERS:
        _ENCODERS[vocabulary, end_id] = WordEncoder(Tokenizer.from_file(vocabulary), end_id)
    return _ENCODERS[vocabulary, end_id]


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary value per text: its ids as little-endian unsigned 32-bit numbers."""
    data = ids.astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, text -> doc_id, ids (binary, little-endian unsigned 32-bit), the end id last. Whole texts, a null is empty."""
    vocabulary = path or public_tokenizers.path(VOCABULARY)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, end_id)
        for b in pieces(batches, 1, BYTES_AT_ONCE):
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(*encoder.encode(texts))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids binary")


# ---- the shared dictionary -----------------------------------------------------------------------

def id_bytes(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def train_dictionary(encoded: DataFrame, width: int, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the id arrays of encoded (doc_id, ids), a few thousand rows at most. One task trains it, the driver gets `size` bytes at
    most. Nothing if they are too few to train on."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = sorted(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for b in batches for x in b.column(1).to_pylist())
        try:
            made = zstandard.train_dictionary(size, arrays, k=50, d=6, level=LEVEL).as_bytes() if sum(map(len, arrays)) > 10 * size else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    rows = encoded.select("doc_id", "ids").repartition(1).mapInArrow(task, "dictionary binary").collect()
    return bytes(rows[0].dictionary) if rows else b""


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About `sample` documents by a hash of the row, all of them if there are no more, and of these the short ones. A row is taken by itself, so no task
    has to rank rows, and copies do not come together."""
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    total = docs.count()
    return rows.where((F.pmod(F.xxhash64("_row", "text"), F.lit(1 << 40)) < int(min(1.0, sample / max(1, total)) * (1 << 40))) & F.octet_length("text").between(1, SAMPLE_BYTES)).drop("_row")


# ---- the files ---------------------------------------------------------------------------------

def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _write(folder: str, name: str, data: bytes) -> None:
    fs, path = arrow_location(_join(folder, name))
    fs.create_dir(path.rsplit("/", 1)[0])
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def _read(folder: str, name: str) -> bytes:
    fs, path = arrow_location(_join(folder, name))
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()


class Shard:
    """Writes one shard, document by document."""

    def __init__(self, out, dictionary: bytes, width: int):
        self.out, self.width = out, width
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True).compress
        self.at = out.write(HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.width == 2 and len(ids) and int(ids.max()) >= 1 << 16:
            raise ValueError(f"id {int(ids.max())} does not fit two bytes")
        frame = self.pack(ids.astype(f"<u{self.width}").tobytes())
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), len(ids)))
        self.at += self.out.write(frame)

    def close(self) -> None:
        columns = zip(*self.index, strict=True)
        index = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(np.array(c, kind).tobytes() for c, kind in zip(columns, INDEX, strict=True)))
        self.out.write(index)
        self.out.write(TAIL.pack(self.at, len(index), len(self.index), MAGIC))


INDEX = ("<i8", "u1", "<u8", "<u4", "<u8")


class OpenShard:
    """Reads one shard: the index first, then frames by their offsets."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        size = file.size()
        index_at, index_bytes, documents, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        head, self.width, digest = HEAD.unpack(file.read_at(HEAD.size, 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError("this is no file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("this shard was packed with another dictionary")
        data = zstandard.ZstdDecompressor().decompress(file.read_at(index_bytes, index_at))
        self.columns, at = [], 0
        for kind in INDEX:
            self.columns.append(np.frombuffer(data, kind, documents, at))
            at += self.columns[-1].nbytes
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def rows(self, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """doc_id, place (ids before it in the shard), n_tokens, ids of all documents, or of the wanted ids. Only these frames are read."""
        doc_id, known, offset, size, many = self.columns
        before = np.cumsum(many) - many
        which = np.arange(len(doc_id)) if wanted is None else np.flatnonzero(known.astype(bool) & np.isin(doc_id, wanted))
        i = 0
        while i < len(which):
            j = max(i + 1, int(np.searchsorted(np.cumsum(many[which[i:]]), BATCH_IDS, "right")) + i)
            rows = which[i:j]
            if wanted is None:  # neighbours: one read for all of them
                first = int(offset[rows[0]])
                data = memoryview(self.file.read_at(int(offset[rows[-1]] + size[rows[-1]]) - first, first))
                frames = [data[int(offset[r]) - first: int(offset[r]) - first + int(size[r])] for r in rows]
            else:
                frames = [self.file.read_at(int(size[r]), int(offset[r])) for r in rows]
            ids = np.concatenate([np.frombuffer(self.unpack(f), f"<u{self.width}") for f in frames])
            at = np.concatenate(([0], np.cumsum(many[rows]))).astype(np.int64)
            if at[-1] != len(ids):
                raise ValueError("the index does not fit the frames")
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id[rows], mask=known[rows] == 0), pa.array(before[rows].astype(np.int64)), pa.array(many[rows].astype(np.int64)), _lists(ids, at)],
                names=["doc_id", "start", "n_tokens", "ids"])
            i = j


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    documents: int
    ids: int
    lowest: int | None
    highest: int | None


class TokenIdWriter(DataSourceArrowWriter):
    """Writes doc_id, ids; or, with a vocabulary, doc_id, text, whose ids it makes itself: one Python process per task instead of two."""

    def __init__(self, folder: str, width: int, vocabulary: str | None = None, end_id: int = END_ID):
        self.folder, self.width, self.vocabulary, self.end_id = folder, width, vocabulary, end_id

    def _documents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        if self.vocabulary is None:
            for b in iterator:
                for doc_id, code in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    yield doc_id, np.frombuffer(code or b"", "<u4")
            return
        encoder = _encoder(self.vocabulary, self.end_id)
        for b in pieces((b.select(["doc_id", "text"]) for b in iterator), 1, BYTES_AT_ONCE):
            ids, at = encoder.encode([t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()])
            for doc_id, first, last in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield doc_id, ids[first:last]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        name = f"shard-{part:05d}-{uuid.uuid4().hex[:12]}.ids"
        out, shard, total, known = None, None, 0, []
        try:
            for doc_id, values in self._documents(iterator):
                if shard is None:
                    fs, path = arrow_location(_join(self.folder, name))
                    out = fs.open_output_stream(path, compression=None)
                    shard = Shard(out, _read(self.folder, "ids.dictionary"), self.width)
                shard.add(doc_id, values)
                total += len(values)
                if doc_id is not None:
                    known = [min(known[0], doc_id), max(known[1], doc_id)] if known else [doc_id, doc_id]
            if shard is None:
                return Written(part, "", 0, 0, None, None)
            shard.close()
        finally:
            if out is not None:
                out.close()
        return Written(part, name, len(shard.index), total, *(known or (None, None)))

    def commit(self, messages: list[Written | None]) -> None:
        shards = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        _write(self.folder, "shards.json", json.dumps([vars(m) for m in shards]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without shards.json nothing of the folder is ever read."""


@dataclass
class ShardPartition(InputPartition):
    name: str
    first: int


class TokenIdReader(DataSourceReader):
    def __init__(self, folder: str, wanted: list[int] | None):
        self.folder, self.wanted = folder, wanted

    def partitions(self) -> list[ShardPartition]:
        out, first = [], 0
        for s in json.loads(_read(self.folder, "shards.json")):
            if self.wanted is None or (s["lowest"] is not None and any(s["lowest"] <= w <= s["highest"] for w in self.wanted)):
                out.append(ShardPartition(s["name"], first))
            first += s["ids"]
        return out or [ShardPartition("", 0)]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        wanted = None if self.wanted is None else np.array(self.wanted, np.int64)
        fs, path = arrow_location(_join(self.folder, partition.name))
        with fs.open_input_file(path) as file:
            for b in OpenShard(file, _read(self.folder, "ids.dictionary")).rows(wanted):
                yield b.set_column(1, "start", pa.array(b.column(1).to_numpy() + partition.first))


class TokenIds(DataSource):
    """Options: path; id_bytes (writing: 2 or 4), vocabulary and end_id (writing texts: their tokenizer's file); doc_ids (reading: whole numbers with commas between, only these documents)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> TokenIdReader:
        wanted = self.options.get("doc_ids")
        return TokenIdReader(self.options["path"], None if wanted is None else [int(x) for x in wanted.split(",") if x.strip()])

    def writer(self, schema, overwrite: bool) -> TokenIdWriter:
        return TokenIdWriter(self.options["path"], int(self.options.get("id_bytes", 4)), self.options.get("vocabulary"), int(self.options.get("end_id", END_ID)))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) into a new folder of token-ID files, in ascending order of doc_id.

    Null ids come first; rows of one id by a hash of their text. A null text is empty: its end id alone. Repeated rows are
    documents of their own; an empty table gives a folder without shards. Other columns are not looked at. Rows are dealt
    by ranges of (doc_id, hash of the text, row), so no id, however many rows have it, stays in one task."""
    vocabulary = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    width = id_bytes(Tokenizer.from_file(vocabulary).get_vocab_size())
    _write(folder, "ids.dictionary", train_dictionary(encode_documents(training_sample(docs), vocabulary, end_id), width))
    keys = ["doc_id", "_hash", "_row"]
    ordered = (docs.select("doc_id", "text").withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
               .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text"))
    spark.dataSource.register(TokenIds)
    ordered.write.format("token_ids").options(id_bytes=width, vocabulary=vocabulary, end_id=end_id).mode("append").save(folder)


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of a folder of token-ID files. With doc_ids
    only the shards that may hold them are opened, and only their frames read."""
    spark.dataSource.register(TokenIds)
    reader = spark.read.format("token_ids")
    if doc_ids is not None:
        reader = reader.option("doc_ids", ",".join(map(str, doc_ids)))
    return reader.load(folder)
