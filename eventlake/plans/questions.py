"""The on-call questions. Each takes the events (any layout) or a roll-up and returns a DataFrame.

Failures are counted per error code before the lookup is joined: the join then sees a few hundred
rows, so neither a frequent code nor a large lookup makes the raw events move."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import fail_pct, in_window, json_text
from eventlake.operators.rollups import merge_device_bitmaps, merge_device_sketches
from eventlake.session import compute_once


def failed() -> Column:
    return F.col("status") == "fail"


def failures_one_day(events: DataFrame, day: date) -> DataFrame:
    return events.where((F.col("day") == F.lit(day)) & failed()).agg(F.count("*").alias("failures"))


def failures_one_day_rollup(health: DataFrame, day: date) -> DataFrame:
    chosen = health.where((F.col("day") == F.lit(day)) & failed())
    return chosen.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("failures"))


def _with_meaning(per_code: DataFrame, codes: DataFrame, count: str, *keys: str) -> DataFrame:
    """Join counts per error_code with the lookup; codes without a meaning drop out."""
    joined = per_code.join(codes, per_code["error_code"] == codes["code"])
    return joined.groupBy(*keys).agg(F.sum(count).alias(count))


def top_errors(events: DataFrame, codes: DataFrame, first: date, last: date, k: int = 10) -> DataFrame:
    per_code = events.where(in_window(first, last) & failed()).groupBy("error_code").agg(
        F.count("*").alias("failures"))
    named = _with_meaning(per_code, codes, "failures", "error_code", "meaning")
    return named.orderBy(F.desc("failures"), "error_code", "meaning").limit(k)


def top_errors_rollup(errors: DataFrame, codes: DataFrame, first: date, last: date,
                      k: int = 10) -> DataFrame:
    per_code = errors.where(in_window(first, last)).groupBy("error_code").agg(
        F.sum("failures").alias("failures"))
    named = _with_meaning(per_code, codes, "failures", "error_code", "meaning")
    return named.orderBy(F.desc("failures"), "error_code", "meaning").limit(k)


def devices_hit_by_error(events: DataFrame, code: int, first: date, last: date) -> DataFrame:
    hit = events.where(in_window(first, last) & (F.col("error_code") == F.lit(code).cast("smallint")))
    return hit.agg(F.countDistinct("device_id").alias("devices"))


def devices_hit_by_error_rollup(bitmaps: DataFrame, code: int, first: date, last: date) -> DataFrame:
    """From the stored daily bitmaps: exact for any window, without the events."""
    chosen = bitmaps.where(in_window(first, last) & (F.col("error_code") == F.lit(code).cast("smallint")))
    return merge_device_bitmaps(chosen)


def devices_hit_by_error_sketched(sketches: DataFrame, code: int, first: date, last: date) -> DataFrame:
    """From the stored daily sketches: an estimate from far fewer bytes than the bitmaps'."""
    chosen = sketches.where(in_window(first, last) & (F.col("error_code") == F.lit(code).cast("smallint")))
    return merge_device_sketches(chosen).select(F.coalesce("devices", F.lit(0)).alias("devices"))


def _worst(groups: DataFrame, k: int) -> DataFrame:
    rated = groups.select("device_model", "os_version", "events",
                          fail_pct(F.col("failures"), F.col("events")).alias("fail_pct"))
    return rated.orderBy(F.desc("fail_pct"), "device_model", "os_version").limit(k)


def fail_rate_by_model_os(events: DataFrame, k: int = 10) -> DataFrame:
    groups = events.groupBy("device_model", "os_version").agg(
        F.count("*").alias("events"), F.count_if(failed()).alias("failures"))
    return _worst(groups, k)


def fail_rate_by_model_os_rollup(health: DataFrame, k: int = 10) -> DataFrame:
    """A group without any failure rates 0, as from the raw events."""
    groups = health.groupBy("device_model", "os_version").agg(
        F.sum("events").alias("events"),
        F.sum(F.when(failed(), F.col("events")).otherwise(0)).alias("failures"))
    return _worst(groups, k)


def device_history(events: DataFrame, device_id: int, first: date, last: date,
                   k: int = 100) -> DataFrame:
    """Latest events of one device; event_id breaks ties."""
    own = events.where(in_window(first, last) & (F.col("device_id") == device_id))
    newest = own.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(k)
    return newest.select("event_id", "event_ts", "event_type", "status", "error_code")


def _failures_by(events: DataFrame, conn: Column, first: date, last: date) -> DataFrame:
    chosen = events.where(in_window(first, last) & failed())
    return chosen.groupBy(conn.alias("conn")).agg(F.count("*").alias("failures"))


def failures_by_conn_json(events: DataFrame, first: date, last: date) -> DataFrame:
    return _failures_by(events, json_text("payload", "conn"), first, last)


def failures_by_conn_column(cleaned: DataFrame, first: date, last: date) -> DataFrame:
    return _failures_by(cleaned, F.col("conn"), first, last)


def what_broke(events: DataFrame, codes: DataFrame, day: date, k: int = 3) -> DataFrame:
    keys = ("device_model", "os_version")
    per_code = events.where((F.col("day") == F.lit(day)) & failed()).groupBy(*keys, "error_code").agg(
        F.count("*").alias("n"))
    named = _with_meaning(per_code, codes, "n", *keys, "meaning")
    return named.orderBy(F.desc("n"), *keys, "meaning").limit(k)


def failures_per_day(events: DataFrame, first: date, last: date) -> DataFrame:
    chosen = events.where(in_window(first, last) & failed())
    return chosen.groupBy("day").agg(F.count("*").alias("failures")).orderBy("day")


def failures_per_day_rollup(health: DataFrame, first: date, last: date) -> DataFrame:
    chosen = health.where(in_window(first, last) & failed())
    return chosen.groupBy("day").agg(F.sum("events").alias("failures")).orderBy("day")


def events_per_status(events: DataFrame, day: date) -> DataFrame:
    return events.where(F.col("day") == F.lit(day)).groupBy("status").agg(F.count("*").alias("events"))


def profile_counts(events: DataFrame) -> DataFrame:
    """Events per day, model, OS, status and error code: all that a profile needs but the devices, in one scan.

    It has as many rows as there are such groups, however many events; conditions on a key reach the scan."""
    return events.groupBy("day", "device_model", "os_version", "status", "error_code").agg(F.count("*").alias("events"))


def _sums() -> tuple[Column, Column]:
    """Failures and events of a group of profile_counts()."""
    bad = F.sum(F.when(failed(), F.col("events")).otherwise(0))
    return F.coalesce(bad, F.lit(0)), F.coalesce(F.sum("events"), F.lit(0))


def profile_overview(counts: DataFrame, events: DataFrame) -> DataFrame:
    """Rows, days, devices and fail rate. Days come from the counts and devices from a scan of their own column, so that
    no event is sent once per distinct count."""
    bad, n = _sums()
    totals = counts.agg(n.alias("rows"), F.countDistinct("day").alias("days"), fail_pct(bad, n).alias("fail_pct"))
    devices = events.agg(F.countDistinct("device_id").alias("devices"))
    both = totals.unionByName(devices, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("rows", "days", "devices", "fail_pct")])


def profile_daily_range(counts: DataFrame) -> DataFrame:
    """Lowest and highest fail rate of a day."""
    daily = counts.groupBy("day").agg(fail_pct(*_sums()).alias("pct"))
    return daily.agg(F.min("pct").alias("lowest"), F.max("pct").alias("highest"))


def profile_top_codes(counts: DataFrame, k: int = 5) -> DataFrame:
    counted = counts.where(failed()).groupBy("error_code").agg(F.sum("events").alias("failures"))
    return counted.orderBy(F.desc("failures"), "error_code").limit(k)


def profile_top_models(counts: DataFrame, k: int = 3) -> DataFrame:
    counted = counts.groupBy("device_model").agg(F.sum("events").alias("events"), fail_pct(*_sums()).alias("fail_pct"))
    return counted.orderBy(F.desc("events"), "device_model").limit(k)


def profile_incident(counts: DataFrame, model: str, os_version: str, day: date) -> DataFrame:
    """Fail rate of one model and OS on one day, against all other days."""
    own = counts.where((F.col("device_model") == model) & (F.col("os_version") == os_version))
    which = F.when(F.col("day") == F.lit(day), "bad day").otherwise("other days").alias("which")
    return own.groupBy(which).agg(fail_pct(*_sums()).alias("fail_pct"))


def profile_events(events: DataFrame, model: str, os_version: str, day: date) -> dict[str, DataFrame]:
    """A quick look at a data set: five small tables. Events are scanned once for the counts, which are kept in the
    shared folder, and once for the devices."""
    counts = compute_once(profile_counts(events))
    return {
        "overview": profile_overview(counts, events),
        "daily_range": profile_daily_range(counts),
        "top_codes": profile_top_codes(counts),
        "top_models": profile_top_models(counts),
        "incident": profile_incident(counts, model, os_version, day),
    }
