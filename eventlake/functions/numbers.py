"""Rates, list lookups and reproducible sampling numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fail_pct(failed: Column, total: Column) -> Column:
    """Percent with two decimals, as a double; NULL where there is nothing to rate."""
    return F.round(F.lit(100.0) * failed / F.nullif(total, F.lit(0)), 2)


def pick(values: Sequence[str], index: Column) -> Column:
    """Item of a literal list, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def hash_uniform(*columns: Column | str, salt: int = 0, seed: int = 0) -> Column:
    """Number in [0, 1) that depends only on the values, the salt and the seed.

    Gives the same answer on any cluster, so samples and splits can be repeated."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.pmod(F.xxhash64(*parts, F.lit(salt), F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
