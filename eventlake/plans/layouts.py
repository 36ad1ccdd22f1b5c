"""Write the same events in different layouts.

The cleaned layer is dealt out by ranges of its sort key. The other writers shuffle by day with a rebalance hint: adaptive execution merges small days into one
task and splits a day that is too large into several tasks and files, so no day has to pass
through one task. The file size follows spark.sql.adaptive.advisoryPartitionSizeInBytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.fixed_values import SORT_KEY, SORTED_ROW_GROUP_BYTES, TINY_FILES_PER_DAY
from eventlake.functions import json_text
from eventlake.operators.rollups import (
    rollup_daily_errors,
    rollup_daily_health,
    rollup_device_bitmaps,
    rollup_device_sketches,
)
from eventlake.schemas import EVENT_CLEAN
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import CSV_WRITE, LAYOUTS, error_codes, read_layout
from eventlake.sources.files import list_files
from eventlake.sources.views import DEVICE_SETS, SMALL_TABLES, read_small_table


def with_conn(events: DataFrame) -> DataFrame:
    """The connection type as a column of its own; the payload stays as it is."""
    return events.withColumn("conn", json_text("payload", "conn"))


def in_layout_order(events: DataFrame, sort_by: Iterable[str] = SORT_KEY) -> DataFrame:
    """Sort inside each task. The day leads, because the partitioned writer would otherwise
    sort again by day alone and lose the order."""
    return events.sortWithinPartitions("day", *[F.asc_nulls_last(c) for c in sort_by])


def _write_days(df: DataFrame, path: str, *folders: str, replace_days: bool = False,
                row_group_bytes: int | None = None, rows_per_file: int = 0, bloom: Iterable[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd").partitionBy("day", *folders)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    for column in bloom:
        # of the sizes it tries, the writer keeps the smallest one that fits the row group's values
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if replace_days:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.option("partitionOverwriteMode", "static")
    writer.parquet(path)


def write_by_day(events: DataFrame, path: str, replace_days: bool = False) -> None:
    """Parquet in day folders. With replace_days, only the days in `events` are replaced."""
    _write_days(events.hint("rebalance", "day"), path, replace_days=replace_days)


def in_day_ranges(events: DataFrame, sort_by: Iterable[str] = SORT_KEY) -> DataFrame:
    """Deal rows out by sampled ranges of (day, sort key, event_id), so that a day that is cut over many tasks is cut along the sort
    key: what is rare in it, like failures, lies in a few of its files and not in all. The event id comes last, so
    that no value is too frequent to be cut. Adaptive execution puts small neighbours together."""
    return events.repartitionByRange("day", *[F.asc_nulls_last(c) for c in sort_by], "event_id")


def write_sorted(cleaned: DataFrame, path: str, replace_days: bool = False) -> None:
    """The cleaned layer: day folders whose files are sorted ranges of the day, so that rare failures sit together
    and readers can skip the rest. The device is in no sort key; a Bloom filter per row group tells where it is not.

    A connection type that is not there yet is taken from the payload behind the shuffle, once; before it, the pass that samples the
    ranges would take it too."""
    ranged = in_day_ranges(cleaned.select(*[c for c in EVENT_CLEAN.fieldNames() if c in cleaned.columns or c != "conn"]))
    ordered = in_layout_order((ranged if "conn" in ranged.columns else with_conn(ranged)).select(*EVENT_CLEAN.fieldNames()))
    # small row groups, so that sorted values leave many of them to skip
    _write_days(ordered, path, replace_days=replace_days, row_group_bytes=SORTED_ROW_GROUP_BYTES, bloom=("device_id",))


def write_tiny_files(events: DataFrame, path: str, per_day: int = TINY_FILES_PER_DAY,
                     replace_days: bool = False, max_rows_per_file: int = 5_000_000) -> None:
    """Many small files per day, as a streaming loader leaves them; kept as the bad example.

    Not rebalanced: adaptive execution would put thousands of small files into one task."""
    spread = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = events.withColumn("chunk", F.pmod("event_id", F.lit(per_day)).cast("int"))
    _write_days(chunked.repartition(spread, "day", "chunk"), path, "chunk", replace_days=replace_days,
                rows_per_file=max_rows_per_file)


def write_single(events: DataFrame, path: str) -> None:
    """All days in one table without folders, the day stored as a column. A table that fits one
    file becomes one file; a larger one is split instead of passing through one task."""
    events.hint("rebalance").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(events: DataFrame, path: str) -> None:
    """All days as plain CSV with a header; large tables are split into several files."""
    events.hint("rebalance").write.mode("overwrite").options(**CSV_WRITE).csv(path)


ROLLUPS = (("rollup_daily_health", rollup_daily_health), ("rollup_daily_errors", rollup_daily_errors))
SETS = (("rollup_daily_device_bitmaps", rollup_device_bitmaps),
        ("rollup_daily_device_sketches", lambda events: rollup_device_sketches(events, "error_code")))


def write_rollups(events: DataFrame, root: str, days: list[date] | None = None) -> None:
    """Build the daily roll-ups and the daily sets of failing devices, for all days or only for days that were touched.

    A folder per month holds a few files sorted by day, so a year of days is no thousand tiny files. Touched days are
    built again and put together with the others of their months; a month is replaced whole. All tables are staged
    first and then published together."""
    spark = events.sparkSession
    touched = events if days is None else events.where(F.col("day").isin(days))
    months = {f"{d:%Y-%m}" for d in days or ()}
    run = uuid.uuid4().hex[:12]
    journal = f"{root}/rollups_journal"

    def place(name: str) -> str:
        table, _, folder = name.partition("--")
        return f"{root}/{(SMALL_TABLES | DEVICE_SETS)[table][0]}/{folder}"

    hf.recover(spark, place, journal)
    moves: dict[str, tuple[str | None, str]] = {}
    empty = []
    for name, rollup in ROLLUPS + SETS:
        folder, schema = (SMALL_TABLES | DEVICE_SETS)[name]
        path = f"{root}/{folder}"
        rows = rollup(touched)
        fresh = not hf.exists(spark, path)
        if days is not None and not fresh:
            month = F.date_format("day", "yyyy-MM")
            rest = read_small_table(spark, root, name).where(month.isin(sorted(months)) & ~F.col("day").isin(days))
            rows = rows.unionByName(rest)
        staged = f"{root}/_incoming/{name}-{run}"
        placed = rows.withColumn("month", F.date_format("day", "yyyy-MM"))
        (placed.hint("rebalance", "month").sortWithinPartitions("month", *[c for c in ("day", "status", "error_code", "bucket") if c in placed.columns])
         .write.option("compression", "zstd").partitionBy("month").parquet(staged))
        built = {n for n in hf.child_names(spark, staged) if n.startswith("month=")}
        old = {n for n in hf.child_names(spark, path) if n.startswith("month=")}
        gone = old - built if days is None else {f"month={m}" for m in months} & old - built
        moves |= {f"{name}--{n}": (f"{staged}/{n}" if n in built else None, place(f"{name}--{n}")) for n in built | gone}
        if fresh and not built:
            empty.append((path, schema))
    hf.publish(spark, moves, journal)
    for path, schema in empty:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    for name, _ in ROLLUPS + SETS:
        hf.drop(spark, f"{root}/_incoming/{name}-{run}")


def write_error_codes(spark: SparkSession, root: str, first: int = 1000, count: int = 200) -> None:
    codes = error_codes(spark, first, count)
    codes.coalesce(1).write.mode("overwrite").parquet(f"{root}/{SMALL_TABLES['error_codes'][0]}")


def missing_days(spark: SparkSession, root: str, layout: str, wanted: Iterable[date]) -> list[date]:
    """Days asked for that the layout does not have yet."""
    present = hf.present_days(spark, f"{root}/{LAYOUTS[layout][0]}")
    return sorted(set(wanted) - set(present))


def _source_state(spark: SparkSession, root: str) -> dict[date, tuple[int, int, str]]:
    """Files, bytes and time of the last change of each day of the by_day layout, from one listing."""
    listed = list_files(spark, f"{root}/by_day", "*.parquet")
    day = F.to_date(F.regexp_extract("path", r"day=(\d{4}-\d{2}-\d{2})", 1))
    rows = listed.groupBy(day.alias("day")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").cast("string").alias("changed"))
    return {r["day"]: (r["files"], r["bytes"], r["changed"]) for r in rows.collect()}


_STATE = "layout string, day date, files long, bytes long, changed string"


def _built_from(spark: SparkSession, root: str) -> dict[str, dict[date, tuple[int, int, str]]]:
    """What each layout was built from, as build_layouts() noted."""
    out: dict[str, dict[date, tuple[int, int, str]]] = {}
    if hf.exists(spark, f"{root}/_built_from"):
        for r in spark.read.schema(_STATE).parquet(f"{root}/_built_from").collect():
            out.setdefault(r["layout"], {})[r["day"]] = (r["files"], r["bytes"], r["changed"])
    return out


def build_layouts(spark: SparkSession, root: str, force: bool = False,
                  layouts: Iterable[str] = ("sorted", "tiny_files", "single", "csv")) -> list[str]:
    """Build the named layouts, the lookup and the roll-ups from the by_day layout under a root, at any size.

    What was built before is left alone as long as its days are as they were: days that are new, changed or gone are built
    again, single and csv as a whole. Roll-ups follow the days of the cleaned layer that were touched. Roll-ups need
    the layout sorted."""
    now = _source_state(spark, root) if hf.exists(spark, f"{root}/by_day") else {}
    if not now:
        raise FileNotFoundError(f"there are no days under {root}/by_day")
    events = read_layout(spark, root, "by_day")
    before = {} if force else _built_from(spark, root)
    built = []
    wanted = list(dict.fromkeys(layouts))
    if unknown := set(wanted) - set(LAYOUTS) - {"by_day"}:
        raise ValueError(f"there is no layout {', '.join(sorted(unknown))}")

    def stale(layout: str) -> list[date]:
        """Days to build again, from what was noted; a layout that is not there is built whole."""
        path = f"{root}/{LAYOUTS[layout][0]}"
        old = before.get(layout, {}) if hf.exists(spark, path) else {}
        return sorted(d for d in now.keys() | old.keys() if now.get(d) != old.get(d))

    def note(layout: str) -> None:
        before[layout] = dict(now)
        rows = [(name, d, *state) for name, days in before.items() for d, state in days.items()]
        staged = f"{root}/_incoming/built_from-{uuid.uuid4().hex[:12]}"
        spark.createDataFrame(rows, _STATE).coalesce(1).write.parquet(staged)
        hf.publish(spark, {"note": (staged, f"{root}/_built_from")}, f"{root}/_built_from_journal")
        built.append(layout)

    by_day = {"sorted": write_sorted, "tiny_files": write_tiny_files}
    for name in (n for n in by_day if n in wanted):
        if todo := stale(name):
            staged = f"{root}/_incoming/{name}-{uuid.uuid4().hex[:12]}"
            by_day[name](events.where(F.col("day").isin(todo)), staged)
            hf.replace_days(spark, staged, f"{root}/{name}", todo)
            if name == "sorted":
                fresh = not hf.exists(spark, f"{root}/{SMALL_TABLES['rollup_daily_health'][0]}")
                write_rollups(read_layout(spark, root, "sorted"), root, None if fresh else todo)
                built += [n for n, _ in ROLLUPS]
            note(name)
    for name, write in (("csv", write_csv), ("single", write_single)):
        if name in wanted and stale(name):
            staged = f"{root}/_incoming/{name}-{uuid.uuid4().hex[:12]}"
            write(events, staged)
            hf.publish(spark, {name: (staged, f"{root}/{name}")}, f"{root}/{name}_journal")
            note(name)
    if force or not hf.exists(spark, f"{root}/lookup/error_codes/_SUCCESS"):
        write_error_codes(spark, root)
        built.append("error_codes")
    return built
