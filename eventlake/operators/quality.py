"""Rules the event table has to obey, each answered by a number of bad rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.fixed_values import BATTERY_RANGE, CONNECTIONS, MAX_LATE_HOURS, RETRIES_RANGE

PAYLOAD = "conn string, battery string, retries string"


def status_mismatch() -> Column:
    return (F.col("status") == "fail") != F.col("error_code").isNotNull()


def arrival_off() -> Column:
    latest = F.col("event_ts") + F.make_dt_interval(hours=F.lit(MAX_LATE_HOURS))
    return (F.col("ingested_at") < F.col("event_ts")) | (F.col("ingested_at") > latest)


def payload_off(parsed: Column) -> Column:
    """Takes the payload parsed with PAYLOAD."""
    battery = parsed["battery"].try_cast("int")
    retries = parsed["retries"].try_cast("int")
    return (~parsed["conn"].isin(*CONNECTIONS)
            | ~battery.between(*BATTERY_RANGE) | ~retries.between(*RETRIES_RANGE))


def quality_report(events: DataFrame) -> DataFrame:
    """(rule, bad_rows): every number has to be 0. The row-wise rules share one scan."""
    row_rules = {
        "status and error code disagree": status_mismatch(),
        "arrival time off": arrival_off(),
        "payload off": payload_off(F.col("parsed")),
    }
    one_scan = events.withColumn("parsed", F.from_json("payload", PAYLOAD)).agg(*[F.count_if(bad).alias(rule) for rule, bad in row_rules.items()])
    stacked = F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("bad_rows"))
        for rule in row_rules]))
    repeats = events.agg((F.count("*") - F.countDistinct("event_id")).alias("bad_rows"))
    looks = F.concat("device_model", "os_version", "firmware_version", "country")
    changed = (
        events.select("device_id", looks.alias("looks")).where("looks IS NOT NULL").distinct()
        .groupBy("device_id").count().where("count > 1")
        .agg(F.count("*").alias("bad_rows"))
    )
    return (
        one_scan.select(stacked)
        .unionByName(repeats.select(F.lit("event id repeated").alias("rule"), "bad_rows"))
        .unionByName(changed.select(F.lit("device attributes changed").alias("rule"), "bad_rows"))
    )
