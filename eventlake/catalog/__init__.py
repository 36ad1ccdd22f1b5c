"""Queries that can be run by name over the shared test tables, with SQL to hold them against."""

from __future__ import annotations

from eventlake.catalog import governed, jobs, layouts, questions, relational, reports  # noqa: F401
from eventlake.catalog.base import REGISTRY, Entry

__all__ = ["REGISTRY", "Entry"]
