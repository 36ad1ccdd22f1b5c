"""Distinct devices: exact, approximate, and the error of adding up daily counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions import in_window


def exact_and_approx(events: DataFrame, windows: dict[str, tuple[date, date] | None],
                     rsd: float = 0.05) -> DataFrame:
    """Exact and approximate distinct devices per window, with the error in percent.

    All exact counts come from one shuffle on the device: each device carries a flag per window.
    All approximate counts come from one scan without a shuffle of rows."""
    inside = {name: (in_window(*w) if w else F.lit(True)) for name, w in windows.items()}
    flags = events.where(F.col("device_id").isNotNull()).groupBy("device_id").agg(
        *[F.bool_or(cond).alias(f"in_{i}") for i, cond in enumerate(inside.values())])
    exact = flags.agg(*[F.count_if(F.col(f"in_{i}")).alias(f"n_{i}") for i in range(len(windows))])
    approx = events.agg(*[
        F.approx_count_distinct(F.when(cond, F.col("device_id")), rsd).alias(f"n_{i}")
        for i, cond in enumerate(inside.values())])

    def long(df: DataFrame, value: str) -> DataFrame:
        items = F.array(*[F.struct(F.lit(name).alias("window"), F.col(f"n_{i}").alias(value))
                          for i, name in enumerate(windows)])
        return df.select(F.inline(items))

    error = 100.0 * F.abs(F.col("approx") - F.col("exact")) / F.col("exact")
    return (
        long(exact, "exact").join(long(approx, "approx"), "window")
        .withColumn("error_pct", F.round(F.when(F.col("exact") > 0, error), 2))
    )


def overcount(events: DataFrame, first: date, last: date) -> DataFrame:
    """Devices with a failure in the window, against the sum of their daily counts."""
    pairs = (
        events.where(in_window(first, last) & (F.col("status") == "fail")
                     & F.col("device_id").isNotNull())
        .select("day", "device_id").distinct()
    )
    counts = pairs.groupBy("device_id").agg(F.count("*").alias("days")).agg(
        F.count("*").alias("true_devices"),
        F.coalesce(F.sum("days"), F.lit(0)).alias("added_up"),
    )
    extra = F.col("added_up") - F.col("true_devices")
    return counts.withColumn(
        "overcount_pct",
        F.round(F.when(F.col("true_devices") > 0, 100.0 * extra / F.col("true_devices")), 1))
