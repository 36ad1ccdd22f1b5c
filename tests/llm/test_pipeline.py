"""Each stage of the corpus pipeline against plain Python, on what its predecessor kept."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_documents import brute_exact, brute_fingerprint, groups

import corpus_pipeline
from eventlake.llm import bpe, mixing, quality
from eventlake.llm.common import read, stored
from pyspark.sql import functions as F


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage")
        seen.append((before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    def rows(df):
        return Counter(tuple(r) for r in df.collect())

    (raw, good), (_, single), (_, apart), (_, mixed), (_, coded) = seen
    model = quality.fit_on_labels(raw, read(spark, sf_dir, "labels"))
    rejected = {r.doc_id for r in quality.scores(raw, model).where(F.col("score") < quality.THRESHOLD).collect()}
    assert rejected and rows(good) == rows(raw.where(~F.col("doc_id").isin(sorted(rejected))))

    keep = {k[0] for k in brute_exact([(r.doc_id, r.text) for r in good.collect()]) if k[3]}
    assert rows(single) == rows(good.where(F.col("doc_id").isin(sorted(keep))))

    prints = {r.doc_id: brute_fingerprint(r.text) for r in single.collect()}
    fps = sorted(set(prints.values()))
    a = np.array(fps, np.uint64)
    of = groups(fps, [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1])
    first = {}
    for d, f in prints.items():
        first[of[f]] = min(first.get(of[f], d), d)
    assert rows(apart) == rows(single.where(F.col("doc_id").isin(sorted(first.values()))))

    units = apart.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    copies = {r.doc_id: r.copies for r in mixing.mix_units(units).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})
    assert set(rows(mixed)) <= set(rows(apart))

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = Counter()
    for r in mixed.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert rows(coded) == want


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
