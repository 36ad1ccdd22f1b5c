"""Load report batches: keep the raw table as it came, and a hot table with columns pulled out of
the nested JSON, the newest row per id, sorted in day folders."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.fixed_values import RAW_ROW_GROUP_BYTES
from eventlake.functions import (
    as_bigint,
    as_double,
    clock_bad,
    duration_minutes,
    is_malformed,
    json_path,
    json_schema,
    list_count,
    utc_clock,
    utc_day,
)
from eventlake.operators.dedupe import latest_per_key
from eventlake.schemas import BATCH_AUDIT, EXAMPLE_REPORT, ReportSpec
from eventlake.sources import hadoop_files as hf
from eventlake.sources.files import list_files
from eventlake.sources.report_files import BadBatch, batch_name, checked_files, read_report_files
from eventlake.sources.runs import append_records, utc_now

_LEAF = {"string": lambda c: c, "double": as_double, "bigint": as_bigint}


def report_json_schema(spec: ReportSpec) -> T.StructType:
    """All leaves as text (they are converted afterwards, leniently), lists as lists of text."""
    leaves = [(path, T.StringType()) for path, _ in spec.json_fields.values()]
    leaves += [(path, T.StringType()) for path in spec.durations.values()]
    leaves += [(path, T.ArrayType(T.StringType())) for path in spec.list_counts.values()]
    return json_schema(leaves)


def hot_columns(spec: ReportSpec, parsed: Column) -> list[Column]:
    columns = [F.col(source).alias(name) for name, source in spec.file_fields.items()]
    columns.append(F.col("day"))
    columns.append(clock_bad(utc_clock(F.col(spec.device_clock)), utc_clock(F.col(spec.server_clock)))
                   .alias("clock_bad"))
    for name, (path, kind) in spec.json_fields.items():
        columns.append(_LEAF[kind](json_path(parsed, path)).alias(name))
    for name, path in spec.durations.items():
        columns.append(duration_minutes(json_path(parsed, path)).alias(name))
    for name, path in spec.list_counts.items():
        columns.append(list_count(json_path(parsed, path)).alias(name))
    return columns


def parse_reports(raw: DataFrame, spec: ReportSpec = EXAMPLE_REPORT) -> DataFrame:
    """Hot columns of raw reports; the JSON is parsed once per row."""
    parsed = F.from_json(F.col(spec.json_column), report_json_schema(spec))
    return raw.withColumn("_parsed", parsed).select(*hot_columns(spec, F.col("_parsed")))


def latest_reports(raw: DataFrame, spec: ReportSpec = EXAMPLE_REPORT, repeats: bool = True) -> DataFrame:
    """Newest report per id. Columns are pulled out first, so that the shuffle carries the narrow
    hot columns and not the JSON text."""
    parsed = F.from_json(F.col(spec.json_column), report_json_schema(spec))
    hot = raw.withColumn("_parsed", parsed).select(
        *hot_columns(spec, F.col("_parsed")),
        F.col(spec.id_column).alias("_id"), F.col(spec.server_clock).alias("_clock"))
    if repeats:
        hot = latest_per_key(hot, "_id", "_clock")
    return hot.drop("_id", "_clock")


def ingest_batch(spark: SparkSession, path: str, root: str,
                 spec: ReportSpec = EXAMPLE_REPORT) -> dict[str, object]:
    """Load one batch (a file or a folder of files), replacing an earlier load of the same batch.

    Both tables are built and checked under <root>/_incoming and moved in together at the end. A load that was cut off
    while moving is undone first, whatever becomes of this one."""
    batch = batch_name(path)
    started, begin = utc_now(), time.perf_counter()
    incoming = f"{root}/_incoming/{batch}"
    finals = {t: f"{root}/{t}/batch={batch}" for t in ("reports_raw", "reports_hot")}
    journal = f"{root}/_replaced/{batch}"
    hf.recover(spark, finals.__getitem__, journal)
    hf.drop(spark, incoming)
    try:
        audit = _build(spark, path, incoming, spec)
    except BadBatch:
        hf.drop(spark, incoming)
        raise
    hf.publish(spark, {t: (f"{incoming}/{t}", final) for t, final in finals.items()}, journal)
    hf.drop(spark, incoming)

    raw_mb, raw_files = _size(spark, f"{root}/reports_raw/batch={batch}")
    hot_mb, hot_files = _size(spark, f"{root}/reports_hot/batch={batch}")
    record = {"batch": batch, "started_at": started, **audit, "files": raw_files + hot_files,
              "raw_mb": raw_mb, "hot_mb": hot_mb,
              "seconds": round(time.perf_counter() - begin, 2)}
    row = tuple(record[name] for name in BATCH_AUDIT.fieldNames())
    append_records(spark, [row], BATCH_AUDIT, f"{root}/batch_runs")
    return record


def _build(spark: SparkSession, path: str, incoming: str, spec: ReportSpec) -> dict[str, int]:
    files = checked_files(spark, path)
    arrived = read_report_files(spark, files, spec)
    # The CSV is read once, here; everything later reads this Parquet copy, which splits well
    # even where the CSV (quoted line breaks, gzip) does not.
    (arrived.withColumn("day", utc_day(F.col(spec.server_clock)))
     .write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.size", RAW_ROW_GROUP_BYTES)
     .option("maxRecordsPerFile", 1_000_000)
     .parquet(f"{incoming}/reports_raw"))
    raw = spark.read.parquet(f"{incoming}/reports_raw")

    facts = raw.agg(
        F.count("*").alias("rows"),
        F.countDistinct(spec.id_column).alias("ids"),
        F.count_if(F.col(spec.id_column).isNull()).alias("null_ids"),
        F.count_if(F.col("day").isNull()).alias("null_days"),
        F.count_if(F.col(spec.json_column).isNull()).alias("no_json"),
        F.count_if(is_malformed(F.col(spec.json_column))).alias("malformed"),
    ).first()
    repeats = facts["rows"] - facts["ids"]
    if facts["null_ids"]:
        raise BadBatch(f"{facts['null_ids']} rows have no {spec.id_column}, "
                       "so rows in and rows out cannot agree")
    if facts["null_days"]:
        raise BadBatch(f"{facts['null_days']} rows have no {spec.server_clock} to take a day from")
    if facts["malformed"]:
        raise BadBatch(f"{facts['malformed']} rows hold malformed JSON in {spec.json_column}")

    hot = latest_reports(raw, spec, repeats=repeats > 0)
    (hot.hint("rebalance", "day").sortWithinPartitions("day", *spec.sort_by)
     .write.mode("overwrite").option("compression", "zstd").partitionBy("day")
     .parquet(f"{incoming}/reports_hot"))

    if facts["rows"]:
        per_day = (spark.read.schema(hot.schema).parquet(f"{incoming}/reports_hot")
                   .groupBy("day").agg(F.count("*").alias("rows")))
        done = per_day.agg(F.sum("rows").alias("rows"), F.count("*").alias("days")).first()
        hot_rows, days = done["rows"], done["days"]
    else:
        hot_rows = days = 0
    if hot_rows != facts["rows"] - repeats:
        raise BadBatch(f"{facts['rows']} rows with {repeats} repeats came in, "
                       f"but the hot table would hold {hot_rows}")
    return {"rows": facts["rows"], "repeats": repeats, "rows_without_json": facts["no_json"],
            "hot_rows": hot_rows, "days": days}


def _size(spark: SparkSession, path: str) -> tuple[float, int]:
    row = list_files(spark, path, "*.parquet").agg(
        F.sum("length").alias("bytes"), F.count("*").alias("files")).first()
    return round((row["bytes"] or 0) / 1e6, 2), row["files"]


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """All batches as they came. Extra columns may differ from batch to batch."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/reports_raw")


def read_hot(spark: SparkSession, root: str, spec: ReportSpec = EXAMPLE_REPORT) -> DataFrame:
    """All batches of the hot table; batch and day are folders, both can be pruned."""
    base = ", ".join(f"`{c}` {t}" for c, t in spec.file_columns.items())
    empty = spark.createDataFrame([], f"{base}, day date")
    kinds = parse_reports(empty, spec).schema
    schema = T.StructType([*[f for f in kinds.fields if f.name != "day"],
                           T.StructField("batch", T.StringType()),
                           T.StructField("day", T.DateType())])
    return spark.read.schema(schema).parquet(f"{root}/reports_hot")
