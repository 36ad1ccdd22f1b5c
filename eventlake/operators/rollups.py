"""Daily roll-ups and their further aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEALTH_KEYS = ("day", "device_model", "os_version", "status")


def rollup_daily_health(events: DataFrame) -> DataFrame:
    return events.groupBy(*HEALTH_KEYS).agg(
        F.count("*").alias("events"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )


def rollup_daily_errors(events: DataFrame) -> DataFrame:
    return (
        events.where("status = 'fail'").groupBy("day", "error_code")
        .agg(F.count("*").alias("failures"), F.countDistinct("device_id").alias("devices"))
    )


def rollup_device_bitmaps(events: DataFrame) -> DataFrame:
    """The failing devices of each day and error code, exactly: one bit per device id, 32,768 ids to a bitmap of 4 KB, and a row for
    each bitmap that has a bit. A bitmap grows with the range of ids, not with the events."""
    return (
        events.where("status = 'fail' and device_id is not null")
        .groupBy("day", "error_code", F.bitmap_bucket_number("device_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("device_id")).alias("bitmap"))
    )


def merge_device_bitmaps(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Exact distinct devices over all merged bitmaps; without keys, one row, 0 if there are none."""
    merged = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("_bits"))
    return merged.groupBy(*keys).agg(F.coalesce(F.sum("_bits"), F.lit(0)).alias("devices"))


def rollup_device_sketches(events: DataFrame, *keys: str) -> DataFrame:
    """Distinct counts cannot be added up over days, sketches can be merged: one sketch of the
    failing devices per day (and any further keys)."""
    return (
        events.where("status = 'fail'").groupBy("day", *keys)
        .agg(F.hll_sketch_agg("device_id").alias("device_sketch"))
    )


def merge_device_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Estimated distinct devices over all merged sketches."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("device_sketch")).alias("devices")
    return sketches.groupBy(*keys).agg(merged)


def coarser(rollup: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Add up counts of a roll-up over fewer keys. Distinct counts must not be passed here."""
    return rollup.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
