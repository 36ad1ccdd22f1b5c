"""How often a value changes along the rows of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.sources.files import with_row_position

ROWS_PER_RUN = 1_000_000


def count_flips(df: DataFrame, column: str, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Changes of `column` from one row to the next, per file.

    A file is cut into runs of bounded length, counted on their own; then only the ends of
    neighbouring runs are compared. No task has to hold or sort a whole file."""
    placed = with_row_position(df.select(column)).select(
        "file", "row_index", F.floor(F.col("row_index") / rows_per_run).alias("run"),
        F.col(column).alias("value"),
    )
    along = Window.partitionBy("file", "run").orderBy("row_index")
    runs = (
        placed.withColumn("before", F.lag("value").over(along))
        .groupBy("file", "run")
        .agg(F.count_if(F.col("value") != F.col("before")).alias("inside"),
             F.min_by("value", "row_index").alias("first"),
             F.max_by("value", "row_index").alias("last"))
    )
    across = Window.partitionBy("file").orderBy("run")
    return (
        runs.withColumn("before", F.lag("last").over(across))
        .groupBy("file")
        .agg((F.sum("inside") + F.count_if(F.col("first") != F.col("before"))).alias("flips"))
    )
