"""Registry, reference days, shared SQL pieces and the layouts queries read from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from eventlake.fixed_values import (
    CONNECTIONS,
    COUNTRIES,
    ERROR_MEANINGS,
    FIRMWARES,
    MODELS,
    OS_VERSIONS,
    RESEND_ONE_IN,
)
from eventlake.functions import window
from eventlake.operators.zone_map import ZoneMap, save_zone_map
from eventlake.plans import layouts as lay
from eventlake.schemas import SCAN_STATS
from eventlake.session import new_scratch
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import CSV_WRITE, device_events, read_layout
from eventlake.sources.footers import read_row_groups

FIRST_DAY = date(2024, 1, 1)
BAD_DAY = date(2024, 1, 30)
WEEK = window(BAD_DAY, 7)
MONTH = window(BAD_DAY, 30)
ERROR_CODE = 1042
DEVICE = 7
MODEL, OS_VERSION = "DX-300", "ios17"

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return add


# ---- SQL pieces -------------------------------------------------------------------------------

def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


EV = f"""e0 AS (
    SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e1 AS (
    SELECT event_id, ts AS event_ts, ts + k * INTERVAL 1 MINUTE AS ingested_at, user_id AS device_id,
           {_list(MODELS)}[1 + user_id % 12] AS device_model,
           {_list(OS_VERSIONS)}[1 + user_id % 8] AS os_version,
           {_list(FIRMWARES)}[1 + user_id % 5] AS firmware_version,
           {_list(COUNTRIES)}[1 + user_id % 15] AS country,
           event_type,
           CASE WHEN event_type = 'error' THEN CAST(1000 + k AS SMALLINT) END AS error_code,
           CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status,
           CAST(round(value * 100) AS INTEGER) AS duration_ms,
           {_list(CONNECTIONS)}[1 + k % 3] AS conn, 5 + k % 96 AS battery, k % 4 AS retries,
           CAST(ts AS DATE) AS day, k
    FROM e0),
ev AS (
    SELECT *, '{{"conn":"' || conn || '","battery":' || battery || ',"retries":' || retries || '}}'
              AS payload FROM e1)"""

EC = f"""ec AS (
    SELECT CAST(code AS SMALLINT) AS code, {_list(ERROR_MEANINGS)}[1 + code % 10] AS meaning
    FROM range(1000, 1200) t(code))"""

HEALTH = """health AS (
    SELECT day, device_model, os_version, status, count(*) AS events,
           CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms
    FROM ev GROUP BY ALL)"""

ERRORS = """errs AS (
    SELECT day, error_code, count(*) AS failures, count(DISTINCT device_id) AS devices
    FROM ev WHERE status = 'fail' GROUP BY ALL)"""

RAW_COLUMNS = ("event_id, event_ts, ingested_at, device_id, device_model, os_version, "
               "firmware_version, country, event_type, error_code, status, duration_ms, payload")


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts or (EV,)) + "\n" + body


def between(w: tuple[date, date]) -> str:
    return f"day BETWEEN DATE '{w[0]}' AND DATE '{w[1]}'"


# ---- layouts, built once per session and data set ---------------------------------------------

_ROOTS: dict[tuple[str, str], str] = {}
_BUILT: set[tuple[str, str]] = set()
_FOLDERS = {"error_codes": "lookup", "stats_sorted": "stats/sorted", "stats_by_day": "stats/by_day", "zone_map": "stats/zone_map"}


def _root(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROOTS:
        _ROOTS[key] = new_scratch(spark, "layouts")
    return _ROOTS[key]


def built(spark: SparkSession, sf_dir: str, *parts: str) -> str:
    """Root folder under which the wanted parts are in place."""
    root = _root(spark, sf_dir)
    for part in parts:
        if (root, part) not in _BUILT or not hf.exists(spark, f"{root}/{_FOLDERS.get(part, part)}"):
            _BUILDERS[part](spark, sf_dir, root)
            _BUILT.add((root, part))
    return root


def layout(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_layout(spark, built(spark, sf_dir, name), name)


def land(events: DataFrame, path: str) -> None:
    """Arrived files: gzipped CSV in day folders, some events sent twice."""
    again = events.where(f"event_id % {RESEND_ONE_IN} = 0")
    (events.unionByName(again).hint("rebalance", "day")
     .write.mode("overwrite").options(**CSV_WRITE).option("compression", "gzip")
     .partitionBy("day").csv(path))


def _save_stats(spark: SparkSession, sf_dir: str, root: str, name: str) -> None:
    """Row-group statistics are read from the footers once and kept as a table."""
    stats = read_row_groups(spark, f"{built(spark, sf_dir, name)}/{name}")
    stats.hint("rebalance").write.mode("overwrite").parquet(f"{root}/stats/{name}")


def zone_map(spark: SparkSession, sf_dir: str) -> ZoneMap:
    return ZoneMap(spark, f"{built(spark, sf_dir, 'zone_map')}/stats/zone_map")


def row_groups(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = built(spark, sf_dir, f"stats_{name}")
    return spark.read.schema(SCAN_STATS).parquet(f"{root}/stats/{name}")


_BUILDERS = {
    "by_day": lambda s, d, r: lay.write_by_day(device_events(s, d), f"{r}/by_day"),
    "sorted": lambda s, d, r: lay.write_sorted(device_events(s, d), f"{r}/sorted"),
    "tiny_files": lambda s, d, r: lay.write_tiny_files(device_events(s, d), f"{r}/tiny_files"),
    "single": lambda s, d, r: lay.write_single(device_events(s, d), f"{r}/single"),
    "csv": lambda s, d, r: lay.write_csv(device_events(s, d), f"{r}/csv"),
    "rollups": lambda s, d, r: lay.write_rollups(
        read_layout(s, built(s, d, "sorted"), "sorted"), r),
    "error_codes": lambda s, d, r: lay.write_error_codes(s, r),
    "landing": lambda s, d, r: land(device_events(s, d), f"{r}/landing"),
    "stats_sorted": lambda s, d, r: _save_stats(s, d, r, "sorted"),
    "zone_map": lambda s, d, r: save_zone_map(s, row_groups(s, d, "by_day"), f"{r}/stats/zone_map"),
    "stats_by_day": lambda s, d, r: _save_stats(s, d, r, "by_day"),
}
