"""Serving copies of cleaned days and small tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.plans.layouts import write_sorted
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import read_layout
from eventlake.sources.views import SMALL_TABLES, read_small_table


def publish_days(spark: SparkSession, root: str, target: str, days: list[date]) -> DataFrame:
    """Copy cleaned days to a serving copy, replacing exactly these days there, all of them or none.

    Returns the rows per day of the copy."""
    present = set(hf.present_days(spark, f"{root}/sorted"))
    if absent := sorted(set(days) - present):
        raise FileNotFoundError(f"not cleaned yet: {', '.join(map(str, absent))}")
    part = read_layout(spark, root, "sorted").where(F.col("day").isin(days))
    staged = f"{target}/_incoming/sorted-{uuid.uuid4().hex[:12]}"
    write_sorted(part, staged)
    hf.replace_days(spark, staged, f"{target}/sorted", sorted(set(days)))
    copied = read_layout(spark, target, "sorted").where(F.col("day").isin(days))
    return copied.groupBy("day").agg(F.count("*").alias("rows"))


def publish_small_tables(spark: SparkSession, root: str, target: str) -> list[str]:
    """Replace the lookup and the roll-ups whole; what is not built is skipped. Each is staged and moved in at the end."""
    done = []
    for name, (folder, _) in SMALL_TABLES.items():
        if hf.exists(spark, f"{root}/{folder}"):
            table = read_small_table(spark, root, name)
            staged = f"{target}/_incoming/{name}-{uuid.uuid4().hex[:12]}"
            if "day" in table.columns:
                month = table.withColumn("month", F.date_format("day", "yyyy-MM"))
                month.hint("rebalance", "month").write.partitionBy("month").parquet(staged)
            else:
                table.hint("rebalance").write.parquet(staged)
            hf.publish(spark, {name: (staged, f"{target}/{folder}")}, f"{target}/{folder}_journal")
            done.append(name)
    return done
