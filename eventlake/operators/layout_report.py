"""Tables about layouts: sizes, question by layout, growth, and projections."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import LAYOUTS
from eventlake.sources.files import list_files
from eventlake.sources.views import SMALL_TABLES


def layout_files(spark: SparkSession, root: str) -> DataFrame:
    """Data files below a root, each with the layout or roll-up it belongs to."""
    name = F.lit(None).cast("string")
    folders = {layout: folder for layout, (folder, _) in LAYOUTS.items()}
    folders |= {table: folder for table, (folder, _) in SMALL_TABLES.items() if table != "error_codes"}
    # listings write file:/x or file:///x, so everything up to the root's own path is cut off
    below = F.substring_index("path", unquote(urlparse(hf.qualified(spark, root)).path), -1)
    for layout, folder in folders.items():
        name = F.when(below.startswith(f"/{folder}/"), layout).otherwise(name)
    files = list_files(spark, root)
    return files.withColumn("layout", name).where("layout IS NOT NULL")


def layout_sizes(files: DataFrame, rows: int) -> DataFrame:
    """layout, files, mb and bytes per row."""
    total = F.sum("length")
    return files.groupBy("layout").agg(
        F.count("*").alias("files"),
        F.round(total / 1e6, 1).alias("mb"),
        F.round(total / F.lit(float(rows)), 1).alias("bytes_per_row"),
    )


def pivot_measure(measures: DataFrame, value: str, layouts: list[str]) -> DataFrame:
    """One row per question, one column per layout."""
    return measures.groupBy("question").pivot("layout", layouts).agg(F.first(value))


def growth_series(measures: DataFrame, value: str, series: dict[str, Column]) -> DataFrame:
    """One row per row count; each series picks its measurement by a condition."""
    return measures.groupBy("rows").agg(*[
        F.max(F.when(condition, F.col(value))).alias(name) for name, condition in series.items()
    ]).orderBy("rows")


def project_to(measures: DataFrame, target_rows: int, scaled: list[str]) -> DataFrame:
    """Straight-line projection of measurements to another row count."""
    times = F.lit(float(target_rows)) / F.col("rows")
    return measures.withColumns({**{c: F.col(c) * times for c in scaled},
                                 "rows": F.lit(target_rows).cast("bigint")})
