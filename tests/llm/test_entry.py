"""The text operators' queries by name, beside the core's."""

from __future__ import annotations


def test_text_operators_are_registered():
    import __spark_entry__ as entry
    from eventlake.llm.queries import QUERIES, SQL

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys() and SQL.keys() <= QUERIES.keys()
