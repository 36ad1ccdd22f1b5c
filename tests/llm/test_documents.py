"""The operators over documents, against brute force on small tables."""

from __future__ import annotations

import hashlib
import os
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from eventlake.llm import bpe, exact_dedup, mixing, quality, recompression, simhash, suffix_dedup, surrogates
from eventlake.llm.common import LOWER, UPPER, block_hashes, read
from eventlake.llm.queries import QUERIES

TO_LOWER = str.maketrans(UPPER, LOWER)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


# ---- 2

def targets(sizes):
    """By raising a common level until all words are shared."""
    total = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped, rest = {}, total
    while True:
        open_ = [s for s in names if s not in stopped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return stopped | {s: level * weight[s] for s in open_}
        for s in over:
            stopped[s] = 3 * sizes[s]
            rest -= stopped[s]


def check_mix(rows, largest):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3
    want = targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.size * r.copies for r in rs) - want[s]) <= largest[s] + 1e-6


def test_mixing_reaches_its_targets(spark, sf_dir, edge_docs):
    for docs in (read(spark, sf_dir, "documents"), edge_docs):
        units = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
        rows = mixing.mix_units(units, fan_in=8).collect()
        assert len(rows) == docs.count()
        largest = defaultdict(int)
        for r in rows:
            largest[r.source] = max(largest[r.source], r.size)
        check_mix(rows, largest)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_units(units.repartition(5), fan_in=8).collect()))


def test_mixing_keeps_expected_copies(spark):
    """Over many seeds each document is taken as often as its fraction says."""
    units = spark.createDataFrame([(i, "a" if i < 12 else "b", 5 + i % 7) for i in range(40)], "doc_id long, source string, size long")
    taken, rate = Counter(), {}
    for seed in range(12):
        for r in mixing.mix_units(units, seed=seed, fan_in=64).collect():
            taken[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
    for i, n in taken.items():
        assert abs(n / 12 - rate[i]) < 0.6
    assert abs(sum(n / 12 - rate[i] for i, n in taken.items())) < 3


def test_mixed_rows(spark, edge_docs, no_docs):
    mixed = mixing.mix_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    n = edge_docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    assert mixed.count() == sum(r.copies for r in mixing.mix_units(n).collect())
    assert mixing.mix_documents(no_docs).count() == 0


# ---- 3

def brute_fingerprint(text):
    w = (text or "").translate(TO_LOWER).encode().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_links_all(spark, sf_dir, edge_docs):
    for docs in (read(spark, sf_dir, "documents"), edge_docs):
        prints = {(i, t): brute_fingerprint(t) for i, t in pairs(docs)}
        fps = sorted(set(prints.values()))
        a = np.array(fps, np.uint64)
        near = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1]
        group = groups(fps, near)
        ids = defaultdict(list)
        for (i, _), f in prints.items():
            if i is not None:
                ids[group[f]].append(i)
        want = Counter((i, f, min(ids[group[f]], default=None)) for (i, t) in pairs(docs) for f in [prints[i, t]])
        got = Counter((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.SimHashDedup(docs).members().collect())
        assert got == want


def test_simhash_finds_every_distance(spark):
    """Also where so many meet that cells are split."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, replace=False))) for b in base for k in (1, 2, 3, 4)]
    fps = sorted({int(x) for x in [*base, *near]})
    a = np.array(fps, np.uint64)
    want = groups(fps, [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1])
    frame = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    for cell in (4, 4096):
        edges = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in simhash.linked(frame, cell=cell).collect()]
        assert groups(fps, edges) == want


def test_simhash_keeps_one(spark, edge_docs, no_docs):
    found = simhash.SimHashDedup(edge_docs)
    kept = found.kept()
    assert kept.columns == edge_docs.columns
    # two texts under one id can be two components
    of = found.nodes.select("root", "component_id").distinct().collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.component_id for r in of)
    assert simhash.SimHashDedup(no_docs).kept().count() == 0


# ---- 4

def test_quality_on_held_out(spark, sf_dir):
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    got = QUERIES["op4_subword_quality"](spark, sf_dir)
    scored = got.join(read(spark, sf_dir, "labels"), "doc_id").where("held_out and quality is not null").select("predicted", "quality", "score").collect()
    assert len(scored) > 50
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 for r in scored)


def test_quality_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (8, 1), (14, None), (None, 1), (99, 1), (15, 7)], "doc_id long, label int")
    model = quality.fit(edge_docs, labels)
    scores = quality.scores(edge_docs, model).collect()
    assert len(scores) == edge_docs.count() and all(0 <= r.score <= 1 for r in scores)
    again = quality.scores(edge_docs.repartition(1), quality.fit(edge_docs.repartition(1), labels)).collect()
    assert sorted(map(str, scores)) == sorted(map(str, again))
    assert quality.keep_good(edge_docs, model, 0.0).count() == edge_docs.count()
    assert quality.keep_good(edge_docs, model, 0.0).columns == edge_docs.columns
    flat = quality.fit(edge_docs, labels.where("false"))
    assert {r.score for r in quality.scores(edge_docs, flat).collect()} == {0.5}
    assert quality.keep_good(no_docs, flat).count() == 0


def test_features_stay_inside_words():
    flat = np.frombuffer(b"ab  cd\nab", np.uint8)
    kinds = list(quality.features(flat, np.array([0, 6, 9])))
    assert kinds[0][0].tolist() == [0, 0, 1] and kinds[0][1][0] == kinds[0][1][2]
    # ' ab ' has two 3-grams and one 4-gram
    assert [len(r) for r, _ in kinds[2:]] == [6, 3, 0]


# ---- 5

def test_surrogates(spark):
    rows = [(1, "mail jane.doe7@mail.example.com and JANE.DOE7@MAIL.example.com, ip 10.0.0.200."), (2, "card 4012 8888 8888 1881 or 4012888888881881!"),
            (3, "call +1 (743) 555-3824 now"), (4, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'), (5, "Mrs. Anna Schmidt met Herr Schmidt"), (6, "Господин Иван Петров"),
            (7, "clean text with 12 numbers, 3.14 and a 2020-01-02 date"), (8, None), (9, ""), (10, "ssn 123-45-6789 twice 123-45-6789"), (11, "jane.doe7@other.example.org"), (11, "jane.doe7@other.example.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_replaced", F.lit("x")).withColumn("_map", F.lit(1))
    got = {r.doc_id: r for r in surrogates.replace_private(docs, "k").collect()}
    assert [got[i].text for i in (7, 8, 9)] == [rows[6][1], None, ""] and {got[i].n_replaced for i in (7, 8, 9)} == {0}
    for i, n in ((1, 3), (2, 2), (3, 1), (4, 1), (5, 2), (6, 1), (10, 2), (11, 1)):
        assert got[i].n_replaced == n
    for secret in ("jane", "JANE", "10.0.0.200", "4012", "743", "24be", "Schmidt", "Anna", "Петров", "6789"):
        assert not any(secret in (r.text or "") for r in got.values())
    low, high = got[1].text.split(" ")[1], got[1].text.split(" ")[3].rstrip(",")
    assert low.split("@")[0].upper() == high.split("@")[0] and low.endswith(".com") and len(low) == len("jane.doe7@mail.example.com")
    assert got[11].text.split("@")[0] == low.split("@")[0]
    spaced, plain = got[2].text[5:24], got[2].text[28:44]
    assert spaced.replace(" ", "") == plain and spaced[4] == " "
    digits = [int(c) for c in plain]
    assert sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2]) == 10 * ((sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) // 10)
    assert got[3].text.startswith("call +1 (") and len(got[3].text) == len(rows[2][1])
    assert got[5].text.split(" ")[2] == got[5].text.split(" ")[5] and got[5].text.split(" ")[1] in surrogates.GIVEN["latin f"]
    assert got[6].text.split(" ")[1] in surrogates.GIVEN["cyrillic m"]
    assert got[10].text.split(" ")[1] == got[10].text.split(" ")[3]


def test_long_secrets_go_whole(spark):
    rng = np.random.default_rng(5)

    def run(n, of="abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNPQRSTUVWXYZ0123456789"):
        return "".join(rng.choice(list(of), n))

    secrets = ["api_key=" + run(800), "password: " + run(6000), f"eyJ{run(40)}.{run(5000)}.{run(683)}", f"eyJ{run(900)}.{run(900)}.{run(5000)}",
               run(4000, "0123456789abcdef"), run(129, "0123456789ABCDEF"), "sk-" + run(3000)]
    docs = spark.createDataFrame([(i, f"before {s} after") for i, s in enumerate(secrets)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_private(docs).collect()}
    for i, s in enumerate(secrets):
        text = got[i].text
        assert got[i].n_replaced == 1 and text.startswith("before ") and text.endswith(" after") and len(text) == len(s) + 13
        assert not any(s[k:k + 12] in text for k in range(10, len(s) - 11))


def test_surrogates_stay_distinct(spark):
    """Two octets of one digit each leave few surrogates: draws collide, and real ones are in the way."""
    values = [("box", f"{a}{b}") for a in range(10) for b in range(9)] + [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)] + [("given f", f"name{i}") for i in range(60)]
    got = surrogates.dictionary(spark.createDataFrame(values, "kind string, value string"), "k").collect()
    assert {(r.kind, r.value) for r in got} == set(values)
    assert len({(r.kind, r.surrogate) for r in got}) == len(values)
    assert not {(r.kind, r.surrogate) for r in got} & set(values)


# ---- 6

def brute_exact(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[(t or "").translate(TO_LOWER)].append(i)
    out = Counter()
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        once = True
        for i in ids:
            out[i, keep, len(ids), i == keep and once, hashlib.sha256(t.encode()).hexdigest()] += 1
            once = once and i != keep
    return out


def test_exact_dedup(spark, sf_dir, edge_docs, no_docs):
    for docs in (read(spark, sf_dir, "documents"), edge_docs):
        found = exact_dedup.ExactDedup(docs)
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.decisions().collect())
        want = brute_exact(pairs(docs))
        assert got == want
        kept = found.kept()
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if k[3])
    assert exact_dedup.ExactDedup(no_docs).decisions().count() == exact_dedup.ExactDedup(no_docs).kept().count() == 0


def test_rice_code_round_trip():
    rng = np.random.default_rng(1)
    for k in (1, 3, 17):
        for values in (np.array([0]), np.array([0, 1, 2]), np.unique(rng.integers(0, 2 ** 20, 500))):
            assert exact_dedup.rice_decode(*exact_dedup.rice_encode(values, k), len(values), k).tolist() == values.tolist()


# ---- 7

def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes(spark, edge_docs, no_docs, sf_dir, monkeypatch):
    # the long texts are only a count away from each other, so the brute force is run without them
    docs = edge_docs.where("coalesce(doc_id, 0) not in (6, 7)")
    some = read(spark, sf_dir, "documents").where("length(text) < 2500")
    for frame in (docs, some):
        rows = pairs(frame)
        want = Counter((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 200), strict=True))
        for crowd in (4096, 2):
            monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
            got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(frame).collect())
            assert got == want
    whole = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(edge_docs).where("doc_id in (6, 7)").collect()}
    # LONG repeats with a period of 977 * 13 words, so all of it occurs again
    assert whole[6].n_removed == whole[6].n_bytes and whole[7].n_bytes - whole[7].n_removed <= 4
    assert suffix_dedup.remove_repeated_bytes(no_docs).count() == 0


def many_texts(doc_id):
    """So many texts that some share 16 bits of a hash: a passage that all have, further on in each; and shorter ones without it."""
    passage = " ".join(f"common{k}" for k in range(30))
    return [(doc_id, " ".join(f"t{n}x{k}" for k in range(15 + n % 40)) + (" " + passage if n % 2 else "")) for n in range(1500)]


def test_repeated_bytes_of_many_texts_under_one_id(spark):
    for doc_id in (None, 7):
        rows = many_texts(doc_id)
        want = Counter((i, *x) for (i, _), x in zip(rows, brute_bytes([t for _, t in rows], 200), strict=True))
        got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


# ---- 9

def test_bpe_as_the_library(spark, edge_docs, no_docs):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|> it's I'LL 12 ３ ४", "x" * 3000, "日本語 😀😀 é", "   \n\n  x \t y", "!?" * 400, "​ ﻿"]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    want = Counter()
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digest(docs).collect())) == want
    assert bpe.digest(no_docs).count() == 0


def test_bpe_long_lists_and_small_queries(monkeypatch):
    monkeypatch.setattr(bpe, "QUERY_IDS", 7)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 20)
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN)
    texts = ["", "some words to encode, more than one query takes", "x", "überlang" * 9]
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]


def long_matches():
    """Single matches of the pattern: many letters by chance, one letter, runs of spaces and signs, short periods, other scripts."""
    rng = np.random.default_rng(5)

    def drawn(letters, n):
        return "".join(rng.choice(list(letters), n))

    return [drawn("abcdefghijklmnopqrstuvwxyz", 3000), drawn("ab", 2000), drawn("etaoinshr", 2500), "x" * 1777, " " * 1500, "-" * 1300, "=" * 700 + "-" * 700,
            "abc" * 700, "abcde" * 300 + "abcd" * 300, "日本語" * 300, drawn("日本語한국어ελ", 800), "é" * 999, "\n" * 1000, "a" * 128, "a" * 129, "b" * 130, "ab" * 65,
            "".join("supercalifragilistic"[: i % 20 + 1] for i in range(200))]


@pytest.mark.parametrize(("lap", "squares"), [(64, 1 << 23), (8, 1 << 23), (3, 200), (1, 1)])
def test_bpe_long_matches_in_chunks(monkeypatch, lap, squares):
    """The chunks' tokens put together are the library's, whatever the lap, and also where only the whole word will do."""
    monkeypatch.setattr(bpe, "LAP", lap)
    monkeypatch.setattr(bpe, "QUERY_SQUARES", squares)
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t if lap == 64 else t[:150] for t in long_matches()]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_bpe_a_match_of_200_000_bytes(tmp_path, monkeypatch):
    """Ends in seconds, and no query puts anything on disk."""
    monkeypatch.chdir(tmp_path)
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    begin = time.perf_counter()
    got = codec.encode([text])
    assert time.perf_counter() - begin < 60
    assert np.frombuffer(got[0], "<u4").tolist() == enc.encode_ordinary(text)
    assert list(tmp_path.iterdir()) == []


# ---- 10

def brute_words(docs, window):
    first = {}
    for i, t in docs:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k:k + window])
                first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_words(spark, edge_docs, no_docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeated_words(edge_docs).collect())
    assert got == brute_words(pairs(edge_docs), 13)
    assert recompression.remove_repeated_words(no_docs).count() == 0


def test_repeated_words_of_many_texts_under_one_id(spark):
    rows = many_texts(7) + [(1, many_texts(1)[1][1])]
    got = recompression.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, 13)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """Thue-Morse strings and their complements collide under every polynomial modulo 2^64: letters of a word, and words of a text."""
    turn = [bin(i).count("1") % 2 for i in range(4096)]
    same = " ".join(f"w{i}" for i in range(12))
    letters = ["".join("ab"[x ^ y] for x in turn[:1024]) for y in (0, 1)]
    texts = [f"{same} {letters[0]}", f"{same} {letters[1]}", f"{same} {letters[0]} tail", " ".join("ab"[x] for x in turn), " ".join("ba"[x] for x in turn)]
    got = sorted(recompression.remove_repeated_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    seen, want = set(), []
    for text in texts:
        w = text.split()
        windows = [tuple(w[i: i + 13]) for i in range(len(w) - 12)]
        gone = {j for i, x in enumerate(windows) if x in seen for j in range(i, i + 13)}
        want.append(len(gone))
        seen |= set(windows)
    assert [r.n_removed for r in got] == want and want[:3] == [0, 0, 13]


def test_range_names_tell_contents_apart():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    starts = rng.integers(0, 3900, 20_000)
    ends = np.minimum(4000, starts + rng.integers(0, 40, 20_000))
    names = block_hashes(values, starts, ends, 5)
    content = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(names.tolist())) == len(set(content)) == len(set(zip(names.tolist(), content, strict=True)))
    assert len(block_hashes(values, starts[:0], ends[:0], 5)) == 0


def test_repeated_words_in_parts(spark, edge_docs):
    """Texts that go in parts give the same anchors."""
    text = (" ".join(f"w{i % 977} x{i % 13}" for i in range(3000))).encode()
    flat, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = recompression.PART
    try:
        found = []
        for part in (whole, 4000):
            recompression.PART = part
            seen = set()
            for w, _, place, first in recompression.parts(flat, at):
                i, lo, hi, level = recompression.anchors(w, first)
                seen |= set(zip(place[i].tolist(), (lo - i).tolist(), (hi - i).tolist(), level.tolist(), strict=True))
            found.append(seen)
        assert found[0] == found[1] and len(found[0]) == 6000 - 12
    finally:
        recompression.PART = whole
