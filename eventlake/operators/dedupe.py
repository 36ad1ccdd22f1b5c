"""One row per key. Both operators combine on the map side, so a key with very many copies
never travels whole to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop re-sent rows: keep one row per key, always the same one (the smallest)."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("kept"))
    return kept.select(*[c if c in keys else F.col("kept").getField(c).alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, key: str, clock: str, tie_break: Sequence[Column] = ()) -> DataFrame:
    """The row with the newest clock per key. Ties go by a hash of the whole row.

    The rank filter lets Spark keep one row per key and map task before the shuffle."""
    ties = list(tie_break) or [F.xxhash64(*df.columns)]
    newest = Window.partitionBy(key).orderBy(F.desc_nulls_last(clock), *ties)
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def count_repeats(df: DataFrame, key: str, json_column: str | None = None) -> DataFrame:
    """Rows, rows beyond the first per id (a NULL id counts as one), and rows without JSON."""
    measures = [F.count("*").alias("rows"),
                (F.count("*") - F.countDistinct(key)).alias("repeats")]
    if json_column:
        measures.append(F.count_if(F.col(json_column).isNull()).alias("rows_without_json"))
    return df.agg(*measures)
