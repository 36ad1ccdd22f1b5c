"""Register whatever has been built under a root as temporary views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventlake.schemas import (
    ERROR_CODES,
    ROLLUP_DAILY_DEVICE_BITMAPS,
    ROLLUP_DAILY_DEVICE_SKETCHES,
    ROLLUP_DAILY_ERRORS,
    ROLLUP_DAILY_HEALTH,
    RUN,
)
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import LAYOUTS, read_layout

SMALL_TABLES = {
    "error_codes": ("lookup/error_codes", ERROR_CODES),
    "rollup_daily_health": ("rollups/rollup_daily_health", ROLLUP_DAILY_HEALTH),
    "rollup_daily_errors": ("rollups/rollup_daily_errors", ROLLUP_DAILY_ERRORS),
}

# Daily sets of failing devices, kept beside the roll-ups: distinct counts cannot be added up, these can be merged.
DEVICE_SETS = {
    "rollup_daily_device_bitmaps": ("rollups/rollup_daily_device_bitmaps", ROLLUP_DAILY_DEVICE_BITMAPS),
    "rollup_daily_device_sketches": ("rollups/rollup_daily_device_sketches", ROLLUP_DAILY_DEVICE_SKETCHES),
}


def register_views(spark: SparkSession, root: str, layout: str = "sorted") -> list[str]:
    """`events` over the chosen layout, `events_<layout>` for each one built, the small tables
    and `runs`. What does not exist yet is left out."""
    made = []

    def add(name, df):
        df.createOrReplaceTempView(name)
        made.append(name)

    for name, (folder, _) in LAYOUTS.items():
        if hf.exists(spark, f"{root}/{folder}"):
            add(f"events_{name}", read_layout(spark, root, name))
            if name == layout:
                add("events", read_layout(spark, root, name))
    for name, (folder, _) in (SMALL_TABLES | DEVICE_SETS).items():
        if hf.exists(spark, f"{root}/{folder}"):
            add(name, read_small_table(spark, root, name))
    if hf.exists(spark, f"{root}/runs"):
        add("runs", spark.read.schema(RUN).json(f"{root}/runs"))
    return made


def read_small_table(spark: SparkSession, root: str, name: str):
    """The table's own columns; the month of a roll-up's folder is not one of them."""
    folder, schema = (SMALL_TABLES | DEVICE_SETS)[name]
    return spark.read.schema(schema).parquet(f"{root}/{folder}").select(*schema.fieldNames())
