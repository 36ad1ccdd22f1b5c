"""The daily job: arrived CSV files in, cleaned and sorted Parquet days out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.dedupe import one_per_key
from eventlake.plans.layouts import with_conn, write_rollups, write_sorted
from eventlake.schemas import ARRIVAL_AUDIT, DAY_AUDIT, EVENT, EVENT_CLEAN
from eventlake.session import new_scratch
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import count_landing, read_landing, read_layout
from eventlake.sources.files import list_files
from eventlake.sources.runs import append_records


class BadDay(Exception):
    """A day whose cleaned rows are not to be trusted; nothing was published."""


def clean(arrived: DataFrame) -> DataFrame:
    """Drop re-sent events within a day and pull the connection type out of the payload."""
    return with_conn(one_per_key(arrived, ["day", "event_id"]))


def ingest_days(spark: SparkSession, landing: str, root: str, days: list[date],
                expected_rows: Mapping[date, int] | None = None,
                refresh_rollups: bool = False) -> DataFrame:
    """Clean the asked days in one job and replace exactly these days of the cleaned layer.

    The result is staged and checked first: each day must hold as many rows as its arrived files
    hold different event ids, and as many as `expected_rows` says if given. Counts are taken from
    the files, not from accumulators, so that re-run tasks do not disturb them.
    With refresh_rollups the roll-up rows of these days are built again too.
    Returns (and logs under <root>/ingest_runs) one audit row per day."""
    begin = time.perf_counter()
    asked = sorted(set(days))
    if absent := sorted(set(asked) - set(hf.present_days(spark, landing))):
        raise FileNotFoundError(f"nothing arrived for {', '.join(map(str, absent))}")
    arrived = read_landing(spark, landing).where(F.col("day").isin(asked))
    staged = f"{root}/_incoming/{new_scratch(spark, 'days').rsplit('/', 1)[-1]}"

    write_sorted(clean(arrived), staged)

    came = count_landing(spark, landing, asked)
    kept = (spark.read.schema(EVENT_CLEAN).parquet(staged)
            .groupBy("day").agg(F.count("*").alias("rows_out")))
    both = came.join(kept, "day", "left").fillna(0, ["rows_out"])
    counts = {r["day"]: r for r in both.collect()}
    seconds = time.perf_counter() - begin
    problems = []
    for day in asked:
        got, ids = (counts[day]["rows_out"], counts[day]["ids_in"]) if day in counts else (0, 0)
        wanted = {ids}
        if expected_rows and day in expected_rows:
            wanted.add(expected_rows[day])
        if wanted != {got}:
            problems.append(f"{day}: expected {sorted(wanted)} rows, got {got}")
    if problems:
        hf.drop(spark, staged)
        raise BadDay("; ".join(problems))

    hf.replace_days(spark, staged, f"{root}/sorted", asked)
    if refresh_rollups:
        write_rollups(read_layout(spark, root, "sorted"), root, days=asked)

    csv_mb = _mb_per_day(spark, landing, asked)
    parquet_mb = _mb_per_day(spark, f"{root}/sorted", asked)
    audit = []
    for day in asked:
        rows_in, rows_out = (counts[day]["rows_in"], counts[day]["rows_out"]) if day in counts else (0, 0)
        audit.append((day, rows_in, rows_in - rows_out, rows_out, round(seconds, 1),
                      round(rows_in / seconds), csv_mb.get(day, 0.0), parquet_mb.get(day, 0.0)))
    append_records(spark, audit, DAY_AUDIT, f"{root}/ingest_runs")
    return spark.createDataFrame(audit, DAY_AUDIT)


_KEYS = ["day", "event_id"]
_REST = [c for c in EVENT.fieldNames() if c not in _KEYS]


def add_arrivals(spark: SparkSession, arrived: DataFrame, landing: str, root: str,
                 refresh_rollups: bool = False) -> DataFrame:
    """Add newly arrived events to their days, at the cost of what is new and not of what the days hold.

    Of the days touched only the ids are read: new ids go into files of their own beside those that stand, known ids
    are left out. The table holds the rows that cleaning the days whole would give. A re-sent event that differs from
    the stored one and comes before it in the order of one_per_key() has to take its place; a day where that
    happens is cleaned whole from `landing`. Adding the same events again changes nothing, so a run may be repeated.
    Ids must be there, and the stored days must hold each id once, else BadDay and nothing is published.
    `arrived` is read more than once and should be stored. With refresh_rollups the roll-up rows of days that changed are
    built again too. Returns (and logs under <root>/arrival_runs) one audit row per day with arrivals."""
    run = uuid.uuid4().hex[:12]
    staged, marks = f"{root}/_incoming/arrivals-{run}", f"{root}/_incoming/marks-{run}"
    came = {r["day"]: r for r in arrived.groupBy("day").agg(
        F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"),
        F.count_if(F.col("event_id").isNull()).alias("without_id")).collect()}
    days = sorted(d for d in came if d is not None)
    if None in came or any(r["without_id"] for r in came.values()):
        raise BadDay("there are events without a day or an id, so they cannot be told from re-sent ones")
    stored = spark.createDataFrame([], EVENT_CLEAN)
    if hf.exists(spark, f"{root}/sorted"):
        stored = read_layout(spark, root, "sorted").where(F.col("day").isin(days))

    ids = stored.select(*_KEYS, F.lit(True).alias("known"))
    clean(arrived).join(ids, _KEYS, "left").write.option("compression", "zstd").parquet(marks)
    marked = spark.read.parquet(marks)
    known = marked.where("known")
    write_sorted(marked.where("known IS NULL"), staged)

    # only ids that came again are looked up whole
    again = known.select(*_KEYS, F.struct(*_REST).alias("new")).join(
        stored.select(*_KEYS, F.struct(*_REST).alias("old")), _KEYS)
    overruled = sorted(r["day"] for r in again.where("new < old").select("day").distinct().collect())
    counts = {r["day"]: (r["known"], 0) for r in known.groupBy("day").agg(F.count("*").alias("known")).collect()}
    for r in spark.read.schema(EVENT_CLEAN).parquet(staged).groupBy("day").agg(F.count("*").alias("added")).collect():
        counts[r["day"]] = (counts.get(r["day"], (0, 0))[0], r["added"])
    hf.drop(spark, marks)
    if problems := [f"{d}: {came[d]['ids']} ids arrived, {counts.get(d, (0, 0))[0]} known and {counts.get(d, (0, 0))[1]} new"
                    for d in days if sum(counts.get(d, (0, 0))) != came[d]["ids"]]:
        hf.drop(spark, staged)
        raise BadDay("; ".join(problems))

    hf.add_to_days(spark, staged, f"{root}/sorted", [d for d in days if d not in overruled and counts[d][1]])
    if overruled:
        ingest_days(spark, landing, root, overruled)
    changed = sorted({*overruled, *(d for d in days if counts[d][1])})
    if refresh_rollups and changed:
        write_rollups(read_layout(spark, root, "sorted"), root, days=changed)
    audit = [(d, came[d]["rows"], came[d]["rows"] - came[d]["ids"], *counts[d], d in overruled) for d in days]
    if audit:
        append_records(spark, audit, ARRIVAL_AUDIT, f"{root}/arrival_runs")
    return spark.createDataFrame(audit, ARRIVAL_AUDIT)


def compact_days(spark: SparkSession, root: str, days: list[date]) -> None:
    """Put the files that arrivals added to these days in order again: sorted ranges of the day, as cleaning it whole
    leaves it. A day that would not hold as many rows as before stops the job with nothing changed."""
    staged = f"{root}/_incoming/compact-{uuid.uuid4().hex[:12]}"
    before = read_layout(spark, root, "sorted").where(F.col("day").isin(days))
    write_sorted(before, staged)

    def rows(df: DataFrame) -> dict[date, int]:
        return {r["day"]: r["count"] for r in df.groupBy("day").count().collect()}

    had, has = rows(before), rows(spark.read.schema(EVENT_CLEAN).parquet(staged))
    if had != has:
        hf.drop(spark, staged)
        raise BadDay(f"had {had}, would have {has}")
    hf.replace_days(spark, staged, f"{root}/sorted", sorted(had))


def _mb_per_day(spark: SparkSession, root: str, days: list[date]) -> dict[date, float]:
    """Size of the data files per day folder; only the folders asked for are listed."""
    sizes: dict[date, float] = {}
    folders = [f"{root}/day={d}" for d in days if hf.exists(spark, f"{root}/day={d}")]
    if not folders:
        return sizes
    listed = list_files(spark, folders)
    day = F.to_date(F.regexp_extract("path", r"day=(\d{4}-\d{2}-\d{2})", 1))
    for row in listed.groupBy(day.alias("day")).agg(F.sum("length").alias("bytes")).collect():
        sizes[row["day"]] = round(row["bytes"] / 1e6, 1)
    return sizes
