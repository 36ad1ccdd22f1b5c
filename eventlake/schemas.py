"""Table schemas and the field spec of report batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT_RAW = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("device_model", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("firmware_version", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("error_code", T.ShortType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_ms", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])
DAY = T.StructField("day", T.DateType())
EVENT = T.StructType([*EVENT_RAW.fields, DAY])
EVENT_CLEAN = T.StructType([*EVENT_RAW.fields, T.StructField("conn", T.StringType()), DAY])
TINY_EVENT = T.StructType([*EVENT_RAW.fields, DAY, T.StructField("chunk", T.IntegerType())])

ERROR_CODES = T.StructType([
    T.StructField("code", T.ShortType()),
    T.StructField("meaning", T.StringType()),
])
ROLLUP_DAILY_HEALTH = T.StructType([
    DAY,
    T.StructField("device_model", T.StringType()),
    T.StructField("os_version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("events", T.LongType()),
    T.StructField("total_duration_ms", T.LongType()),
])
ROLLUP_DAILY_ERRORS = T.StructType([
    DAY,
    T.StructField("error_code", T.ShortType()),
    T.StructField("failures", T.LongType()),
    T.StructField("devices", T.LongType()),
])
ROLLUP_DAILY_DEVICE_BITMAPS = T.StructType([
    DAY,
    T.StructField("error_code", T.ShortType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("bitmap", T.BinaryType()),
])
ROLLUP_DAILY_DEVICE_SKETCHES = T.StructType([
    DAY,
    T.StructField("error_code", T.ShortType()),
    T.StructField("device_sketch", T.BinaryType()),
])
RUN = T.StructType([
    T.StructField("step", T.StringType()),
    T.StructField("scale", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
DAY_AUDIT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("duplicates_dropped", T.LongType()),
    T.StructField("rows_out", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("rows_per_second", T.LongType()),
    T.StructField("csv_gz_mb", T.DoubleType()),
    T.StructField("parquet_mb", T.DoubleType()),
])
ARRIVAL_AUDIT = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("rows_in", T.LongType()),
    T.StructField("repeats", T.LongType()),
    T.StructField("known", T.LongType()),
    T.StructField("added", T.LongType()),
    T.StructField("cleaned_whole", T.BooleanType()),
])
BATCH_AUDIT = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("repeats", T.LongType()),
    T.StructField("rows_without_json", T.LongType()),
    T.StructField("hot_rows", T.LongType()),
    T.StructField("days", T.LongType()),
    T.StructField("files", T.LongType()),
    T.StructField("raw_mb", T.DoubleType()),
    T.StructField("hot_mb", T.DoubleType()),
    T.StructField("seconds", T.DoubleType()),
])
SCAN_STATS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("row_group", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("lo", T.StringType()),
    T.StructField("hi", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("all_null", T.BooleanType()),
])

JsonPath = tuple[str | int, ...]


@dataclass(frozen=True)
class ReportSpec:
    """Which columns a report batch must have and which become columns of the hot table.

    An int in a path picks an item of a list, counted from 0."""

    file_columns: dict[str, str]
    id_column: str
    json_column: str
    server_clock: str
    device_clock: str
    file_fields: dict[str, str]                       # hot column <- file column
    sort_by: tuple[str, ...]
    json_fields: dict[str, tuple[JsonPath, str]] = field(default_factory=dict)
    durations: dict[str, JsonPath] = field(default_factory=dict)
    list_counts: dict[str, JsonPath] = field(default_factory=dict)


# The example field list; a user passes a spec of their own.
EXAMPLE_REPORT = ReportSpec(
    file_columns={
        "id": "string",
        "created_at": "timestamp",
        "updated_at": "timestamp",
        "device_id": "string",
        "archive_path": "string",
        "device_time": "timestamp",
        "device_kind": "string",
        "summary": "string",
        "in_use": "boolean",
    },
    id_column="id",
    json_column="summary",
    server_clock="updated_at",
    device_clock="device_time",
    file_fields={
        "id": "id",
        "received_at": "updated_at",
        "first_seen_at": "created_at",
        "device_id": "device_id",
        "device_kind": "device_kind",
        "archive_path": "archive_path",
        "device_time": "device_time",
        "in_use": "in_use",
    },
    sort_by=("device_id", "received_at"),
    json_fields={
        "model": (("info", "Model"), "string"),
        "os_version": (("info", "OS Version"), "string"),
        "restart_reason": (("info", "Restart Reason"), "string"),
        "battery_drain": (("info", "Drain"), "double"),
        "err_kernel": (("errors", "Kernel"), "bigint"),
        "err_system": (("errors", "System"), "bigint"),
        "net_state": (("networks", 0, "state"), "string"),
    },
    durations={"uptime_min": ("info", "Uptime")},
    list_counts={"n_usb": ("usb",), "n_time_events": ("time_sync", "Events")},
)
