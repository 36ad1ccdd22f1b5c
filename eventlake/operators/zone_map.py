"""Row-group statistics kept in two levels: a summary per file, and the row groups, both in day folders.

An estimate opens the folders of the days that are asked for, prunes whole files by the summary, and looks at row groups of the
files that are left. What it says is what operators.scan_estimate says from all statistics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions import day_from_path
from eventlake.operators.scan_estimate import Range, estimate_scan, kept_row_groups
from eventlake.schemas import DAY, SCAN_STATS
from eventlake.sources import hadoop_files as hf

ROW_GROUPS = T.StructType([*SCAN_STATS.fields, DAY])
FILES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("groups", T.LongType()),          # row groups that have the column
    T.StructField("null_groups", T.LongType()),     # of them, without any value
    T.StructField("number_groups", T.LongType()),   # of them, with two numbers as bounds
    T.StructField("text_groups", T.LongType()),     # of them, with bounds that are not both numbers
    T.StructField("lo_number", T.DoubleType()),
    T.StructField("hi_number", T.DoubleType()),
    T.StructField("lo_text", T.StringType()),
    T.StructField("hi_text", T.StringType()),
    DAY,
])


def file_summary(stats: DataFrame) -> DataFrame:
    """One row per file and column: the widest bounds of its row groups, of numbers and of any text."""
    lo, hi = F.col("lo").try_cast("double"), F.col("hi").try_cast("double")
    known = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    number = known & lo.isNotNull() & hi.isNotNull()
    return stats.groupBy("file", "column", "day").agg(
        F.count("*").alias("groups"), F.count_if(F.col("all_null")).alias("null_groups"),
        F.count_if(~F.col("all_null") & number).alias("number_groups"), F.count_if(~F.col("all_null") & known & ~number).alias("text_groups"),
        F.min(F.when(number, lo)).alias("lo_number"), F.max(F.when(number, hi)).alias("hi_number"),
        F.min(F.when(known, F.col("lo"))).alias("lo_text"), F.max(F.when(known, F.col("hi"))).alias("hi_text"))


def _all_miss(want: Range) -> Column:
    """Whether every row group of a file misses a range. Never true unless each of them would be skipped by its own bounds."""
    want_lo, want_hi = F.lit(str(want[0])), F.lit(str(want[1]))
    numbers = want_lo.try_cast("double").isNotNull() & want_hi.try_cast("double").isNotNull()
    by_number = (want_hi.try_cast("double") < F.col("lo_number")) | (want_lo.try_cast("double") > F.col("hi_number"))
    by_text = (want_hi < F.col("lo_text")) | (want_lo > F.col("hi_text"))
    rest = F.col("groups") - F.col("null_groups")
    return (F.when(rest == 0, True)
            .when(numbers & (F.col("number_groups") == rest), by_number)
            .when((~numbers | (F.col("number_groups") == 0)) & (F.col("number_groups") + F.col("text_groups") == rest), by_text)
            .otherwise(False))


@dataclass(frozen=True)
class ZoneMap:
    """The two stored tables, read anew by each estimate."""

    spark: SparkSession
    path: str

    def _open(self, table: str, schema: T.StructType, filters: Mapping[str, Range]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        want = filters.get("day")
        if want is None or not all(isinstance(w, date) for w in want):
            return rows
        return rows.where(F.col("day").isNull() | F.col("day").between(F.lit(want[0]), F.lit(want[1])))

    def row_groups(self, columns: Sequence[str], filters: Mapping[str, Range]) -> DataFrame:
        """The statistics of the row groups that the summary cannot rule out, of the columns that matter."""
        # a day counts even where no column of this name is stored
        needed = sorted({*columns, *filters})
        files = self._open("files", FILES, filters)
        ruled_out = F.lit(False)
        for name, want in filters.items():
            ruled_out = ruled_out | ((F.col("column") == name) & _all_miss(want))
        left = files.groupBy("file").agg(F.bool_or(F.coalesce(ruled_out, F.lit(False))).alias("out")).where("not out").select("file")
        groups = self._open("row_groups", ROW_GROUPS, filters)
        # one row per file and row group has to stay, also where a file has none of the columns
        first = F.col("column").isin(*needed) | F.col("column").isin(_ANY)
        return groups.where(first).join(left, "file", "left_semi").select(*SCAN_STATS.fieldNames())

    def kept_row_groups(self, columns: Sequence[str], filters: Mapping[str, Range]) -> DataFrame:
        return kept_row_groups(self.row_groups(columns, filters), columns, filters)

    def estimate(self, columns: Sequence[str], filters: Mapping[str, Range]) -> DataFrame:
        """One row: bytes to read and files touched."""
        return estimate_scan(self.row_groups(columns, filters), columns, filters)


#: A row of each row group under this column name, without bytes: a row group is there, whatever columns it has.
_ANY = "*"


def _with_day(stats: DataFrame) -> DataFrame:
    """stats, a row more for each row group, and the day of the file's folder; none for files that store days themselves."""
    every = stats.unionByName(stats.select("file", "row_group").distinct().select(
        "file", "row_group", F.lit(_ANY).alias("column"), F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"),
        F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("all_null")))
    stores = stats.where(F.col("column") == "day").select("file").distinct().withColumn("stores", F.lit(True))
    return every.join(stores, "file", "left").withColumn("day", F.when(F.col("stores").isNull(), F.to_date(day_from_path(F.col("file"))))).drop("stores")


def _write(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "day").sortWithinPartitions("day", "file", "column").write.mode("overwrite").partitionBy("day").parquet(path)


def save_zone_map(spark: SparkSession, stats: DataFrame, path: str) -> ZoneMap:
    """Keep the statistics of a layout (operators: sources.footers.read_row_groups) in both levels."""
    _write(_with_day(stats), f"{path}/row_groups")
    _write(file_summary(spark.read.schema(ROW_GROUPS).parquet(f"{path}/row_groups")), f"{path}/files")
    return ZoneMap(spark, path)


def refresh_days(zone_map: ZoneMap, stats: DataFrame, days: list[date]) -> None:
    """Put the statistics of these days' files in place of what was kept of these days; a day without files goes."""
    spark, path = zone_map.spark, zone_map.path
    staged = f"{path}/_incoming/{uuid.uuid4().hex[:12]}"
    rows = _with_day(stats).where(F.col("day").isin(days))
    _write(rows, f"{staged}/row_groups")
    _write(file_summary(spark.read.schema(ROW_GROUPS).parquet(f"{staged}/row_groups")), f"{staged}/files")
    moves: dict[str, tuple[str | None, str]] = {}
    for table in ("row_groups", "files"):
        have = set(hf.present_days(spark, f"{staged}/{table}"))
        for d in days:
            moves[f"{table}--day={d}"] = (f"{staged}/{table}/day={d}" if d in have else None, f"{path}/{table}/day={d}")
    hf.recover(spark, lambda name: f"{path}/{name.replace('--', '/', 1)}", f"{path}_journal")
    hf.publish(spark, moves, f"{path}_journal")
    hf.drop(spark, staged)


