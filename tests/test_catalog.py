"""Every registered query gives the answer of its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from check_catalog import compare, connect

from eventlake.catalog import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_its_sql(spark, con, sf_dir, name):
    problem, rows, _ = compare(spark, con, REGISTRY[name], sf_dir)
    assert problem is None, problem
    assert rows > 0


def test_every_query_has_sql():
    assert [n for n, e in REGISTRY.items() if e.sql is None] == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    # every query of the core has SQL; the text operators answer for theirs in tests/llm
    assert REGISTRY.keys() <= entry.queries().keys() and REGISTRY.keys() <= entry.oracle_sql().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() == 10
