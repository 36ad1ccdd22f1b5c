"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last give the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import bpe, mixing, quality
from eventlake.llm.common import read, stored
from eventlake.llm.exact_dedup import ExactDedup
from eventlake.llm.simhash import SimHashDedup


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, accepts."""
    return quality.keep_good(docs, quality.fit_on_labels(docs, read(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return ExactDedup(docs).kept()


def not_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return SimHashDedup(docs).kept()


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks for."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and repetition: its number of tokens, and digests of its ids and of what they decode to."""
    return bpe.digest(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("SimHash near-dedup", not_near),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: A trained classifier and rounding by chance have no SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
