"""Run log: one JSON line per step, kept in a folder that jobs append to."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventlake.schemas import RUN


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def append_records(spark: SparkSession, rows: list[tuple], schema: T.StructType, path: str) -> None:
    """Append a handful of audit records as JSON lines."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType = RUN) -> DataFrame:
    return spark.read.schema(schema).json(path)


@contextmanager
def track(spark: SparkSession, path: str, step: str, scale: str) -> Iterator[None]:
    """Note what ran, when, how long it took and whether it passed; also when it failed."""
    started, begin = utc_now(), time.perf_counter()
    status, error = "done", None
    try:
        yield
    except BaseException as err:
        status, error = "failed", repr(err)
        raise
    finally:
        seconds = round(time.perf_counter() - begin, 2)
        append_records(spark, [(step, scale, started, status, seconds, error)], RUN, path)
