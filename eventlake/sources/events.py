"""Event tables in each layout, and the derivation of events from the shared test tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.fixed_values import (
    CONNECTIONS,
    COUNTRIES,
    ERROR_CODE_COUNT,
    ERROR_MEANINGS,
    FIRMWARES,
    FIRST_ERROR_CODE,
    MODELS,
    OS_VERSIONS,
)
from eventlake.functions import json_text, pick
from eventlake.schemas import DAY, EVENT, EVENT_CLEAN, EVENT_RAW, TINY_EVENT

# layout name -> (folder below the root, schema)
LAYOUTS: dict[str, tuple[str, T.StructType]] = {
    "csv": ("csv", EVENT),
    "single": ("single", EVENT),
    "by_day": ("by_day", EVENT),
    "sorted": ("sorted", EVENT_CLEAN),
    "tiny_files": ("tiny_files", TINY_EVENT),
}

# A quote inside a quoted field is doubled, as in JSON text inside CSV; a value that does not
# fit its type stops the job.
CSV_READ = {"header": True, "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": True, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def read_csv_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_RAW) -> DataFrame:
    """Typed scan of CSV event files, plain or gzip; no inference pass over the data.

    A file whose header has other names, or the same ones in another order, stops the job."""
    return spark.read.options(**CSV_READ).option("enforceSchema", False).schema(schema).csv(path)


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan with inferred types. Costs one more pass, and error_code comes out wider."""
    return spark.read.options(**CSV_READ).option("inferSchema", True).csv(path)


def read_landing(spark: SparkSession, root: str) -> DataFrame:
    """Arrived CSV files in day folders; the day is the one of the folder."""
    return read_csv_events(spark, root, EVENT)


def stream_landing(spark: SparkSession, root: str) -> DataFrame:
    """Rows of arriving CSV files, each file once. Files count however long ago they were written."""
    files = spark.readStream.options(**CSV_READ).option("enforceSchema", False).option("maxFileAge", "36500d")
    return files.schema(EVENT).csv(root)


def count_landing(spark: SparkSession, root: str, days: list[date]) -> DataFrame:
    """Rows and different event ids that arrived per day.

    Counted from the lines as text, where the id is the first field. That is several times cheaper
    than a second CSV parse, and it does not share the mistakes of the first one."""
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), DAY])).text(root)
    first = F.trim(F.trim(F.substring_index("value", ",", 1)), F.lit('"'))
    header = EVENT_RAW.fieldNames()[0]
    records = lines.where(F.col("day").isin(days) & (F.trim("value") != "") & (first != header))
    return records.groupBy("day").agg(
        F.count("*").alias("rows_in"), F.countDistinct(first.cast("bigint")).alias("ids_in"))


def read_layout(spark: SparkSession, root: str, layout: str) -> DataFrame:
    folder, schema = LAYOUTS[layout]
    if layout == "csv":
        return read_csv_events(spark, f"{root}/{folder}", schema)
    return spark.read.schema(schema).parquet(f"{root}/{folder}")


def read_one_day(spark: SparkSession, root: str, layout: str, day: date) -> DataFrame:
    """The files of one day folder as they are, without the day column of the folder name."""
    folder, schema = LAYOUTS[layout]
    stored = T.StructType([f for f in schema.fields if f.name != "day"])
    return spark.read.schema(stored).parquet(f"{root}/{folder}/day={day}")


def error_codes(spark: SparkSession, first: int = FIRST_ERROR_CODE,
                count: int = ERROR_CODE_COUNT) -> DataFrame:
    """Lookup of error codes and their meanings."""
    code = F.col("id")
    return spark.range(first, first + count).select(
        code.cast("smallint").alias("code"),
        pick(ERROR_MEANINGS, code % len(ERROR_MEANINGS)).alias("meaning"),
    )


def device_events(spark: SparkSession, sf_dir: str, first: date | None = None,
                  last: date | None = None) -> DataFrame:
    """Device events from the shared `events` table.

    Bounds given here become range filters on the stored timestamp and reach the Parquet scan."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if first is not None:
        raw = raw.where(F.col("ts") >= F.lit(str(first)).cast("timestamp_ntz"))
    if last is not None:
        raw = raw.where(F.col("ts") < F.lit(str(last + timedelta(days=1))).cast("timestamp_ntz"))
    # used many times over, so it is a column and taken from its text once
    raw = raw.withColumn("k", json_text("props", "k").cast("int"))
    k, user = F.col("k"), F.col("user_id")
    failed = F.col("event_type") == "error"
    payload = F.to_json(F.struct(
        pick(CONNECTIONS, k % 3).alias("conn"),
        (k % 96 + 5).alias("battery"),
        (k % 4).alias("retries"),
    ))
    return raw.select(
        "event_id",
        F.col("ts").alias("event_ts"),
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("ingested_at"),
        user.alias("device_id"),
        pick(MODELS, user % 12).alias("device_model"),
        pick(OS_VERSIONS, user % 8).alias("os_version"),
        pick(FIRMWARES, user % 5).alias("firmware_version"),
        pick(COUNTRIES, user % 15).alias("country"),
        "event_type",
        F.when(failed, k + FIRST_ERROR_CODE).cast("smallint").alias("error_code"),
        F.when(failed, F.lit("fail")).otherwise(F.lit("ok")).alias("status"),
        F.round(F.col("value") * 100).cast("int").alias("duration_ms"),
        payload.alias("payload"),
        F.to_date("ts").alias("day"),
    )
