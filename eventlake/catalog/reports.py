"""Report batches made from the shared events: three versions per report id, nested JSON with
quotes and line breaks, device clocks that run off, missing JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.catalog.base import BAD_DAY, EV, query, sql
from eventlake.fixed_values import MODELS, OS_VERSIONS
from eventlake.functions import json_text, pick, utc_clock, utc_day
from eventlake.plans.report_batches import ingest_batch, read_hot, read_raw
from eventlake.schemas import BATCH_AUDIT, EXAMPLE_REPORT
from eventlake.session import new_scratch
from eventlake.sources import hadoop_files as hf
from eventlake.sources.report_files import BadBatch, checked_files, read_report_files
from eventlake.sources.runs import read_runs

WRITE = {"header": True, "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}


def report_rows(s: SparkSession, d: str, note: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of a report file; note makes another note from the number of an event."""
    def zoned(wall):
        return F.to_timestamp(F.concat(wall.cast("string"), F.lit("Z")))

    # the number and the clock are used many times over, so they are columns and taken from their texts once
    events = s.read.parquet(f"{d}/events.parquet").withColumns(
        {"k": json_text("props", "k").cast("int"), "at": zoned(F.col("ts"))})
    k, n = F.col("k"), F.col("k").cast("string")
    info = F.struct(
        pick(MODELS, F.col("user_id") % 12).alias("Model"),
        pick(OS_VERSIONS, F.col("user_id") % 8).alias("OS Version"),
        F.concat(F.lit('he said "no",\nthen '), n).alias("Restart Reason"),
        F.col("value").alias("Drain"),
        F.when(k % 9 == 0, "none").otherwise(F.concat(n, F.lit(" hours, "), (k % 7).cast("string"), F.lit(" minutes"))).alias("Uptime"))
    errors = F.struct(k.alias("Kernel"), (k * 2).cast("string").alias("System"))
    states = F.when(k % 3 > 0, F.array(F.struct(F.concat(F.lit("up"), (k % 5).cast("string")).alias("state"))))
    numbers = F.when(k % 4 > 0, F.sequence(F.lit(1), k % 4))
    times = F.struct(F.sequence(F.lit(0), k % 5).alias("Events"))
    summary = F.to_json(F.struct(
        info.alias("info"), errors.alias("errors"), F.coalesce(states, F.array()).alias("networks"),
        numbers.alias("usb"), times.alias("time_sync")))
    return events.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 3).cast("string")).alias("id"),
        (F.col("at") - F.make_dt_interval(hours=F.lit(1))).alias("created_at"),
        F.col("at").alias("updated_at"),
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("device_id"),
        F.concat(F.lit("a/"), F.col("event_id").cast("string")).alias("archive_path"),
        F.when(F.col("event_id") % 11 != 0, zoned(F.col("ts") + F.make_dt_interval(days=k - 50)))
         .alias("device_time"),
        F.col("event_type").alias("device_kind"),
        F.when(F.col("event_id") % 13 != 0, summary).alias("summary"),
        (F.col("event_type") == "purchase").alias("in_use"),
        (F.col("event_type") if note is None else note(k)).alias("note"))


REPORTS = """rep AS (
    SELECT 'r' || (event_id // 3) AS id, event_ts - INTERVAL 1 HOUR AS first_seen_at,
           event_ts AS received_at, 'd' || device_id AS device_id, 'a/' || event_id AS archive_path,
           CASE WHEN event_id % 11 <> 0 THEN event_ts + (k - 50) * INTERVAL 1 DAY END AS device_time,
           event_type AS device_kind, event_type = 'purchase' AS in_use, day,
           event_id % 13 <> 0 AS has_json, device_model, os_version, k,
           CAST(duration_ms AS DOUBLE) / 100 AS value
    FROM ev),
hot AS (
    SELECT id, received_at, first_seen_at, device_id, device_kind, archive_path, device_time, in_use, day,
           (device_time > received_at + INTERVAL 1 DAY OR device_time < received_at - INTERVAL 30 DAY) AS clock_bad,
           CASE WHEN has_json THEN device_model END AS model,
           CASE WHEN has_json THEN os_version END AS os_version,
           CASE WHEN has_json THEN 'he said "no",' || chr(10) || 'then ' || k END AS restart_reason,
           CASE WHEN has_json THEN value END AS battery_drain,
           CASE WHEN has_json THEN CAST(k AS BIGINT) END AS err_kernel,
           CASE WHEN has_json THEN CAST(k * 2 AS BIGINT) END AS err_system,
           CASE WHEN has_json AND k % 3 > 0 THEN 'up' || (k % 5) END AS net_state,
           CASE WHEN has_json AND k % 9 <> 0 THEN CAST(k * 60 + k % 7 AS BIGINT) END AS uptime_min,
           CASE WHEN has_json THEN CAST(k % 4 AS BIGINT) ELSE 0 END AS n_usb,
           CASE WHEN has_json THEN CAST(k % 5 + 1 AS BIGINT) ELSE 0 END AS n_time_events
    FROM rep)"""

LATEST = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC) = 1"
TIMES = ("received_at", "first_seen_at", "device_time")


def _plain_times(df: DataFrame) -> DataFrame:
    """Zoned timestamps as UTC wall time, whatever the session zone is."""
    return df.withColumns({c: utc_clock(F.col(c)) for c in TIMES if c in df.columns})


def _batch_file(s, d, label, rows=None, gzip=True):
    path = f"{new_scratch(s, 'batch')}/{label}"
    writer = (rows if rows is not None else report_rows(s, d)).write.options(**WRITE)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
    return path


def _renamed(s, path, label):
    """The same files as another batch, without writing them again."""
    other = f"{path.rsplit('/', 1)[0]}/{label}"
    hf.swap_in(s, path, other)
    return other


def _loaded(s, d, rows=None):
    root = new_scratch(s, "reports")
    ingest_batch(s, _batch_file(s, d, "2024-batch.csv.gz", rows), root)
    return root


HOT_SQL = sql(f"SELECT *, '2024-batch' AS batch FROM hot {LATEST}", EV, REPORTS)


@query("report_batch_hot", HOT_SQL)
def _(s, d):
    return _plain_times(read_hot(s, _loaded(s, d)))


@query("report_batch_without_repeats", sql(
    """SELECT * FROM (SELECT * REPLACE (archive_path AS id), '2024-batch' AS batch FROM hot)""", EV, REPORTS))
def _(s, d):
    rows = report_rows(s, d).withColumn("id", F.col("archive_path"))
    return _plain_times(read_hot(s, _loaded(s, d, rows)))


@query("report_batch_raw", sql(
    """SELECT id, received_at AS updated_at, device_kind AS note, day, has_json,
              CASE WHEN has_json THEN length('he said \\"no\\",\\nthen ' || k) END AS reason_length
       FROM rep""", EV, REPORTS))
def _(s, d):
    raw = read_raw(s, _loaded(s, d))
    utc = utc_clock(F.col("updated_at"))
    reason = F.regexp_extract("summary", r'"Restart Reason":"(he said .*?then \d+)"', 1)
    return raw.select("id", utc.alias("updated_at"), "note", "day",
                      F.col("summary").isNotNull().alias("has_json"),
                      F.length(reason).cast("bigint").alias("reason_length"))


@query("report_batch_audit", sql(
    """SELECT '2024-batch' AS batch, count(*) AS rows, count(*) - count(DISTINCT id) AS repeats,
              count(*) FILTER (WHERE NOT has_json) AS rows_without_json, count(DISTINCT id) AS hot_rows
       FROM rep""", EV, REPORTS))
def _(s, d):
    runs = read_runs(s, f"{_loaded(s, d)}/batch_runs", BATCH_AUDIT)
    return runs.select("batch", "rows", "repeats", "rows_without_json", "hot_rows")


@query("report_batch_replaced", sql(
    f"""SELECT batch, day, count(*) AS rows FROM (
            SELECT * FROM (SELECT 'other' AS batch, * FROM hot {LATEST})
            UNION ALL SELECT * FROM (SELECT '2024-batch' AS batch, * FROM hot
                                     WHERE day <> DATE '{BAD_DAY}' {LATEST}))
        GROUP BY 1, 2""", EV, REPORTS))
def _(s, d):
    root, first = new_scratch(s, "reports"), _batch_file(s, d, "2024-batch.csv.gz")
    ingest_batch(s, first, root)
    ingest_batch(s, _renamed(s, first, "other.csv"), root)
    shorter = report_rows(s, d).where(utc_day(F.col("updated_at")) != F.lit(BAD_DAY))
    ingest_batch(s, _batch_file(s, d, "2024-batch.csv.gz", shorter), root)
    return read_hot(s, root).groupBy("batch", "day").agg(F.count("*").alias("rows"))


@query("report_file_over_many_tasks", sql(
    """SELECT id, received_at, device_kind, day, 'said ""no"",' || chr(10) || k || CASE WHEN k % 2 = 0 THEN chr(13) || chr(10) || '.' ELSE '"' END AS note,
              true AS many_tasks
       FROM rep""".replace('""', '"'), EV, REPORTS))
def _(s, d):
    # plain files with line breaks and quotes inside of their fields, in ranges of 64 KB or more
    def note(k):
        end = F.when(k % 2 == 0, F.lit("\r\n.")).otherwise(F.lit('"'))
        return F.concat(F.lit('said "no",\n'), k.cast("string"), end)

    rows = report_rows(s, d, note).hint("rebalance")
    path = _batch_file(s, d, "big.csv", rows, gzip=False)
    read = read_report_files(s, checked_files(s, path), EXAMPLE_REPORT, range_bytes=1 << 16)
    tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
    return read.select("id", utc_clock(F.col("updated_at")).alias("received_at"), "device_kind", utc_day(F.col("updated_at")).alias("day"), "note", F.lit(tasks > 1).alias("many_tasks"))


@query("report_files_under_wrong_names", sql("SELECT device_kind, count(*) AS rows FROM rep GROUP BY 1", EV, REPORTS))
def _(s, d):
    # gzip files whose names say plain CSV; the scan has to go by their first bytes
    path = _batch_file(s, d, "odd")
    for file in hf.visible_files(s, path):
        hf.swap_in(s, file, file.removesuffix(".gz"))
    rows = read_report_files(s, checked_files(s, path), EXAMPLE_REPORT)
    return rows.groupBy("device_kind").agg(F.count("*").alias("rows"))


@query("report_batch_verdicts", sql(
    """SELECT unnest(['good.csv', 'bad name.csv', 'short.csv', 'no_id.csv', 'broken.csv']) AS batch,
              unnest(['loaded', 'batch name', 'header lacks', 'have no id', 'malformed JSON']) AS verdict,
              count(*) AS rows_in_file FROM ev"""))
def _(s, d):
    root, rows = new_scratch(s, "reports"), report_rows(s, d)
    broken = F.when(F.col("archive_path") == "a/1", F.lit('{"a":1}],[oops')).otherwise(F.col("summary"))
    # a batch of a wrong name holds the rows of the good one
    batches = {"good.csv": rows, "bad name.csv": None, "short.csv": rows.drop("summary"), "no_id.csv": rows.withColumn("id", F.lit(None).cast("string")),
               "broken.csv": rows.withColumn("summary", broken)}
    reasons = ("batch name", "header lacks", "have no id", "malformed JSON")
    out = []
    for name, frame in batches.items():
        path = _renamed(s, path, name) if frame is None else _batch_file(s, d, name, frame)
        try:
            ingest_batch(s, path, root)
            verdict = "loaded"
        except BadBatch as why:
            verdict = next((r for r in reasons if r in str(why)), str(why))
        out.append((name, verdict))
    verdicts = F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(v).alias("verdict")) for b, v in out])
    return rows.agg(F.count("*").alias("rows_in_file")).select(F.inline(verdicts), "rows_in_file")


@query("report_batch_conservation", sql(
    """SELECT '2024-batch' AS batch, count(*) AS rows, count(*) - count(DISTINCT id) AS repeats, count(DISTINCT id) AS hot_rows
       FROM rep""", EV, REPORTS))
def _(s, d):
    """Rows and repeats that the load noted, beside the rows of the hot table as it is read back."""
    root = _loaded(s, d)
    noted = read_runs(s, f"{root}/batch_runs", BATCH_AUDIT).select("batch", "rows", "repeats")
    return noted.join(read_hot(s, root).groupBy("batch").agg(F.count("*").alias("hot_rows")), "batch")
