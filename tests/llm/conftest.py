from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(40_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"),
        (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + " end"), (None, "no id here but some words"), (None, "no id here but some words"), (None, None),
        (8, "Ünïcödé É wörter ÄÖÜ"), (8, "another text under the same id"), (9, "one"), (10, "one two"), (11, "a " * 300), (12, "a " * 300 + "b"),
        (13, "before it " + PASSAGE + " after it"), (14, PASSAGE), (15, "other start " + PASSAGE + " other end of it all"), (16, "ünïcödé É wörter ÄÖÜ"),
        (17, "\x00 control \x1c and \x85 marks"), (18, "\x00 CONTROL \x1c and \x85 marks"),
    ]
    return [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s1"][k % 4], None if k % 2 else len(t or "")) for k, (i, t) in enumerate(texts)]


CLASHING = ["key", "frag", "at", "ats", "tag", "size", "unit", "fp", "node", "root", "_norm", "_sha", "_row", "_fp", "_d", "_h", "_t", "_size", "h", "score", "label", "copies", "component_id", "n_replaced", "_found", "_key", "_map"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows(), DOCS).repartition(3).select("*", *[F.lit("extra").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
