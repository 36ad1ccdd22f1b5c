"""Token-ID files, periodic runs and vector codes, against the library, brute force and small cases by hand."""

from __future__ import annotations

import binascii
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from eventlake.llm import periodic_runs, token_files, vector_codes
from eventlake.llm.queries import QUERIES, SQL, plant_period
from eventlake.session import new_scratch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# ---- 11


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_words_encode_as_whole_texts(tokenizer):
    rng = random.Random(3)
    letters = "abcXYZ'sdltmrevÀßÿ×÷µªº  \t\n\x0b\x1c\x85\xa0́̈İıſΣςσ中文日1२½²–—…🙂‍ _-.,!?<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "don't I'LL we'Ve", "é É é", "", "x" * 5000, "\n".join(["word"] * 5000)]
    encoder = token_files.WordEncoder(tokenizer, token_files.END_ID)
    for i in range(0, len(texts), 100):
        some = texts[i: i + 100]
        ids, at = encoder.encode([t.encode() for t in some])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole(tokenizer, t) for t in some]


def test_other_rules_take_whole_texts(tokenizer):
    other = Tokenizer.from_str(tokenizer.to_str())
    other.normalizer = None
    encoder = token_files.WordEncoder(other, 7)
    assert not encoder.by_words
    ids, at = encoder.encode([b"Some TEXT here", b""])
    assert ids.tolist() == [*other.encode("Some TEXT here", add_special_tokens=False).ids, 7, 7] and at.tolist() == [0, len(ids) - 1, len(ids)]


def test_token_files_of_odd_rows(spark, edge_docs, tokenizer):
    folder = new_scratch(spark, "ids")
    token_files.write_token_files(edge_docs, folder)
    back = token_files.read_token_files(spark, folder).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in back) == sorted((str(r.doc_id), packed(whole(tokenizer, r.text))) for r in edge_docs.collect())
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r.doc_id for r in back), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1]]
    some = token_files.read_token_files(spark, folder, [2, 8, 12345]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == sorted((r.doc_id, r.start) for r in back if r.doc_id in (2, 8))
    assert token_files.read_token_files(spark, folder, []).collect() == []


def test_token_files_of_nothing(spark, no_docs):
    folder = new_scratch(spark, "ids")
    token_files.write_token_files(no_docs, folder)
    assert token_files.read_token_files(spark, folder).collect() == []


def test_token_files_of_a_hot_id(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("one and the same text").alias("text"))
    folder = new_scratch(spark, "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(docs, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == list(range(0, 3000 * 6, 6)) and [r.doc_id for r in back] == sorted(r.doc_id for r in back)
    shards = token_files.TokenIdReader(folder, None).partitions()
    assert len(shards) == 8  # the rows of one id are dealt over several


def test_dictionary_and_bytes(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    width = token_files.id_bytes(tokenizer.get_vocab_size())
    assert width == 2 and token_files.id_bytes(1 << 16) == 2 and token_files.id_bytes((1 << 16) + 1) == 4
    sample = token_files.encode_documents(docs.where("octet_length(text) < 8192"))
    made = token_files.train_dictionary(sample, width, 1024)
    assert 0 < len(made) <= 1024 and made == token_files.train_dictionary(sample, width, 1024)
    assert token_files.train_dictionary(sample.limit(3), width) == b""
    # a shard that was packed with another dictionary is refused
    folder = new_scratch(spark, "ids")
    token_files.write_token_files(docs, folder)
    token_files._write(folder, "ids.dictionary", made)
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(spark, folder).collect()


def test_op11(spark, sf_dir, tokenizer):
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = whole(tokenizer, r.text)
        want.append((r.doc_id, start, len(ids), binascii.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op11_token_files"](spark, sf_dir).collect())) == want


# ---- 12

def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                found.setdefault((s - q, i - s + q), q)  # the smallest period of a stretch comes first
            i += 1
    # a stretch within one of a smaller period has that period
    return sorted((s, n, q) for (s, n), q in found.items() if not any(q2 < q and s2 <= s and s2 + n2 >= s + n for (s2, n2), q2 in found.items()))


def collapse(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_runs_of_made_texts(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(70)
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            p, a = rng.randint(1, 12), rng.randrange(n)
            for i in range(a + p, n):
                w[i] = w[i - p]
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in periodic_runs.periodic_runs(frame).collect():
        w = texts[r.doc_id].split()
        want = brute_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == want, w
        assert r.collapsed == " ".join(collapse(w, want)) and r.n_words == len(w)


def test_runs_of_odd_rows(spark, edge_docs, no_docs):
    want = []
    for r in edge_docs.collect():
        w = (r.text or "").encode().split()
        runs = brute_runs(w) if len(w) < 1000 else []
        want.append((str(r.doc_id), len(w), runs, b" ".join(collapse(w, runs))))
    got = [(str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed.encode()) for r in periodic_runs.periodic_runs(edge_docs).collect()]
    assert sorted(got) == sorted(want)
    assert periodic_runs.periodic_runs(no_docs).collect() == []


def test_very_long_runs(spark):
    texts = ["x " * 300_000, "a b c " * 100_000, " ".join(f"w{i % 977}" for i in range(300_000)), " ".join(f"w{i}" for i in range(200_000))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.length, x.period) for x in r.runs] for r in periodic_runs.periodic_runs(frame).collect()}
    assert got == {0: [(0, 300_000, 1)], 1: [(0, 300_000, 3)], 2: [(0, 300_000, 977)], 3: []}


def test_plant_period():
    words = [b"%d" % i for i in range(50)]
    for doc_id in range(400):
        h = binascii.crc32(str(doc_id).encode())
        got = plant_period(doc_id, words)
        if h % 10:
            assert got == words
        else:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert plant_period(None, words) == words and plant_period(12, []) == []


# ---- 13

def fine(v):
    return bool(v) and len(v) % 4 == 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_codes(rows, entries=256):
    """rows (vec_id, vector, label) -> {position in rows: (code, error)}, books."""
    rows = [r for r in rows if fine(r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.floor(1024 * np.array(r[1])).tolist()))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return [], ""
    V = np.floor(1024 * np.array([r[1] for r in rows], float)).astype(np.int64)
    codes, books, error = [], [], np.zeros(len(V), np.int64)
    for X in np.split(V, 4, axis=1):
        B = X[:entries].copy()
        for turn in range(5):
            D = ((X[:, None] - B[None]) ** 2).sum(2)
            near = D.argmin(1)
            if turn < 4:
                for e in range(len(B)):
                    if (near == e).any():
                        B[e] = X[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        books.append(B)
        error += D.min(1)
    return [(r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), r[2]) for i, r in enumerate(rows)], hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def coded(spark, rows):
    frame = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, v string, pos int").repartition(3)
    out, books = vector_codes.compress(frame)
    got = vector_codes.with_label_error(out).collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    return sorted((str(r.vec_id), r.code, r.error, str(r.label)) for r in got), vector_codes.books_digest(books), out, books


def held(rows):
    want, digest = brute_codes(rows)
    return sorted((str(i), c, e, str(y)) for i, c, e, y in want), digest


def test_codes_of_made_vectors(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(700, 16)), rng.integers(-2, 3, (600, 16)) / 1024]).astype(np.float32)
    v[900:] = v[900]  # a vector that a third of all rows have
    rows = [(int(i), x.tolist(), [None, 1, 2][int(i) % 3]) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    got, digest, out, books = coded(spark, rows)
    assert (got, digest) == held(rows)
    # what a code stands for is as far away as its error says
    by = {i: x for i, x, _ in rows}
    for r in vector_codes.decode(out, books).limit(50).collect():
        assert sum((np.floor(1024 * np.float64(a)) - 1024 * b) ** 2 for a, b in zip(by[r.vec_id], r.decoded, strict=True)) == r.error


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 4, None), (4, [1.0, None, 1.0, 1.0], 2), (5, [nan, 1.0, 1.0, 1.0], 2), (6, [inf, 1.0, 1.0, 1.0], 2), (7, [1.0, 2.0, 3.0, -4.0], None),
            (8, [1.0, 2.0, 3.0, 4.0], 1), (8, [1.0, 2.0, 3.0, 4.0], 1), (8, [1.0, 2.0, -3.0, 4.0], 1), (None, [2.0, 4.0, 1.0, 1.0], None), (9, [1.0] * 8, 1), (10, [1.0] * 3, 1), (11, [1e-30, 2e-30, -1e-30, 31e3], 3)]
    got, digest, _, _ = coded(spark, rows)
    assert (got, digest) == held(rows) and len(got) == 7
    assert coded(spark, [])[0] == [] and coded(spark, rows[:2])[0] == []
    with pytest.raises(Exception, match="32,768 or more"):
        coded(spark, [(1, [1.0, 2.0, 3.0, 4e9], 1)])


def test_trie_of_any_shape():
    rng = np.random.default_rng(8)
    for m, d, spread in ((1, 1, 3), (3000, 4, 4), (3000, 4, 10 ** 7), (5000, 2, 40), (2000, 16, 2)):
        parts = vector_codes._distinct(rng.integers(-spread, spread, (m, d)))[0]
        book = rng.integers(-spread, spread, (37, d))
        book[5] = book[20]
        far = ((parts[:, None] - book[None]) ** 2).sum(2)
        entry, distance = vector_codes.nearest(parts, book)
        assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_vector_codes"])
def test_new_queries_match_their_sql(spark, sf_dir, name):
    from types import SimpleNamespace

    from check_catalog import compare, connect

    problem, rows, _ = compare(spark, connect(sf_dir), SimpleNamespace(run=QUERIES[name], sql=SQL[name]), sf_dir)
    assert problem is None and rows > 0, problem
