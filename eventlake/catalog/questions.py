"""The on-call questions, from raw events, from the cleaned layer and from roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog.base import (
    BAD_DAY,
    DEVICE,
    EC,
    ERROR_CODE,
    EV,
    MODEL,
    MONTH,
    OS_VERSION,
    WEEK,
    between,
    built,
    layout,
    query,
    sql,
)
from eventlake.functions import in_window
from eventlake.operators.rollups import merge_device_bitmaps, merge_device_sketches
from eventlake.plans import questions as ask
from eventlake.sources.events import device_events, error_codes
from eventlake.sources.views import read_small_table

ONE_DAY_SQL = sql(f"SELECT count(*) AS failures FROM ev WHERE day = DATE '{BAD_DAY}' AND status = 'fail'")
TOP_ERRORS_SQL = sql(
    f"""SELECT error_code, meaning, count(*) AS failures
        FROM ev INNER JOIN ec ON ev.error_code = ec.code
        WHERE status = 'fail' AND {between(WEEK)}
        GROUP BY error_code, meaning ORDER BY count(*) DESC, error_code ASC LIMIT 10""", EV, EC)
DEVICES_SQL = sql(f"""SELECT count(DISTINCT device_id) AS devices FROM ev
                      WHERE {between(WEEK)} AND error_code = {ERROR_CODE}""")
FAIL_RATE_SQL = sql(
    """SELECT device_model, os_version, n AS events, round(CAST(100 AS DOUBLE) * bad / n, 2) AS fail_pct
       FROM (SELECT device_model, os_version, count(*) AS n, count(error_code) AS bad FROM ev GROUP BY ALL)
       ORDER BY fail_pct DESC, device_model, os_version LIMIT 10""")
HISTORY_SQL = sql(f"""SELECT event_id, event_ts, event_type, status, error_code FROM ev
                      WHERE device_id = {DEVICE} AND {between(MONTH)}
                      ORDER BY event_ts DESC, event_id DESC LIMIT 100""")
CONN_SQL = sql(f"""SELECT conn, count(*) AS failures FROM ev
                   WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1""")
WHAT_BROKE_SQL = sql(
    f"""SELECT device_model, os_version, meaning, count(*) AS n
        FROM ev INNER JOIN ec ON ev.error_code = ec.code
        WHERE status = 'fail' AND day = DATE '{BAD_DAY}'
        GROUP BY ALL ORDER BY n DESC, device_model, os_version, meaning LIMIT 3""", EV, EC)
PER_DAY_SQL = sql(f"""SELECT day, count(*) AS failures FROM ev
                      WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1""")
PER_STATUS_SQL = sql(f"SELECT status, count(*) AS events FROM ev WHERE day = DATE '{BAD_DAY}' GROUP BY 1")


def on_day(s, d):
    return device_events(s, d, BAD_DAY, BAD_DAY)


def in_week(s, d):
    return device_events(s, d, *WEEK)


def health(s, d):
    return read_small_table(s, built(s, d, "rollups"), "rollup_daily_health")


def errors(s, d):
    return read_small_table(s, built(s, d, "rollups"), "rollup_daily_errors")


def bitmaps(s, d):
    return read_small_table(s, built(s, d, "rollups"), "rollup_daily_device_bitmaps")


def counts(s, d):
    return ask.profile_counts(device_events(s, d))


def _sketched_and_exact(s, d):
    """Estimates of the stored sketches beside the exact counts of the stored bitmaps."""
    sketches = read_small_table(s, built(s, d, "rollups"), "rollup_daily_device_sketches")
    about = merge_device_sketches(sketches.where(in_window(*MONTH)), "error_code")
    exact = merge_device_bitmaps(bitmaps(s, d).where(in_window(*MONTH)), "error_code").withColumnRenamed("devices", "exact")
    near = F.abs(F.col("devices") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return exact.join(about, "error_code").select("error_code", "exact", near.alias("close"))


def cleaned(s, d):
    return layout(s, d, "sorted")


# raw events
query("failures_one_day", ONE_DAY_SQL)(lambda s, d: ask.failures_one_day(on_day(s, d), BAD_DAY))
query("top_errors_week", TOP_ERRORS_SQL)(
    lambda s, d: ask.top_errors(in_week(s, d), error_codes(s), *WEEK))
query("devices_hit_by_error", DEVICES_SQL)(
    lambda s, d: ask.devices_hit_by_error(in_week(s, d), ERROR_CODE, *WEEK))
query("fail_rate_by_model_os", FAIL_RATE_SQL)(
    lambda s, d: ask.fail_rate_by_model_os(device_events(s, d)))
query("one_device_history", HISTORY_SQL)(
    lambda s, d: ask.device_history(device_events(s, d, *MONTH), DEVICE, *MONTH))
query("failures_by_conn_json", CONN_SQL)(
    lambda s, d: ask.failures_by_conn_json(in_week(s, d), *WEEK))
query("what_broke_on_day", WHAT_BROKE_SQL)(
    lambda s, d: ask.what_broke(on_day(s, d), error_codes(s), BAD_DAY))
query("failures_per_day", PER_DAY_SQL)(lambda s, d: ask.failures_per_day(in_week(s, d), *WEEK))
query("events_per_status", PER_STATUS_SQL)(lambda s, d: ask.events_per_status(on_day(s, d), BAD_DAY))

# cleaned layer: day folders, sorted files
query("failures_one_day_sorted", ONE_DAY_SQL)(lambda s, d: ask.failures_one_day(cleaned(s, d), BAD_DAY))
query("top_errors_week_sorted", TOP_ERRORS_SQL)(
    lambda s, d: ask.top_errors(cleaned(s, d), error_codes(s), *WEEK))
query("devices_hit_by_error_sorted", DEVICES_SQL)(
    lambda s, d: ask.devices_hit_by_error(cleaned(s, d), ERROR_CODE, *WEEK))
query("fail_rate_by_model_os_sorted", FAIL_RATE_SQL)(
    lambda s, d: ask.fail_rate_by_model_os(cleaned(s, d)))
query("one_device_history_sorted", HISTORY_SQL)(
    lambda s, d: ask.device_history(cleaned(s, d), DEVICE, *MONTH))
query("failures_by_conn_json_sorted", CONN_SQL)(
    lambda s, d: ask.failures_by_conn_json(cleaned(s, d), *WEEK))
query("failures_by_conn_column", CONN_SQL)(
    lambda s, d: ask.failures_by_conn_column(cleaned(s, d), *WEEK))

# roll-ups
query("failures_one_day_rollup", ONE_DAY_SQL)(
    lambda s, d: ask.failures_one_day_rollup(health(s, d), BAD_DAY))
query("top_errors_week_rollup", TOP_ERRORS_SQL)(
    lambda s, d: ask.top_errors_rollup(errors(s, d), error_codes(s), *WEEK))
query("devices_hit_by_error_rollup", DEVICES_SQL)(
    lambda s, d: ask.devices_hit_by_error_rollup(bitmaps(s, d), ERROR_CODE, *WEEK))
query("devices_hit_by_each_code_rollup", sql(
    f"""SELECT error_code, count(DISTINCT device_id) AS devices FROM ev
        WHERE {between(MONTH)} AND status = 'fail' GROUP BY 1"""))(
    lambda s, d: merge_device_bitmaps(bitmaps(s, d).where(in_window(*MONTH)), "error_code"))
query("stored_sketches", sql(
    f"""SELECT error_code, count(DISTINCT device_id) AS exact, true AS close FROM ev
        WHERE {between(MONTH)} AND status = 'fail' GROUP BY 1"""))(_sketched_and_exact)
query("fail_rate_by_model_os_rollup", FAIL_RATE_SQL)(
    lambda s, d: ask.fail_rate_by_model_os_rollup(health(s, d)))
query("failures_per_day_rollup", PER_DAY_SQL)(
    lambda s, d: ask.failures_per_day_rollup(health(s, d), *WEEK))

# profile of a data set
PCT = "round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE status = 'fail') / count(*), 2)"
query("profile_overview", sql(
    f"""SELECT count(*) AS rows, count(DISTINCT day) AS days, count(DISTINCT device_id) AS devices,
               {PCT} AS fail_pct FROM ev"""))(lambda s, d: ask.profile_overview(counts(s, d), device_events(s, d)))
query("profile_daily_range", sql(
    f"""SELECT min(pct) AS lowest, max(pct) AS highest FROM (SELECT {PCT} AS pct FROM ev GROUP BY day)"""))(
    lambda s, d: ask.profile_daily_range(counts(s, d)))
query("profile_top_codes", sql(
    """SELECT error_code, count(*) AS failures FROM ev WHERE status = 'fail'
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))(lambda s, d: ask.profile_top_codes(counts(s, d)))
query("profile_top_models", sql(
    f"""SELECT device_model, count(*) AS events, {PCT} AS fail_pct FROM ev
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""))(lambda s, d: ask.profile_top_models(counts(s, d)))
query("profile_incident", sql(
    f"""SELECT CASE WHEN day = DATE '{BAD_DAY}' THEN 'bad day' ELSE 'other days' END AS which,
               {PCT} AS fail_pct FROM ev
        WHERE device_model = '{MODEL}' AND os_version = '{OS_VERSION}' GROUP BY 1"""))(
    lambda s, d: ask.profile_incident(counts(s, d), MODEL, OS_VERSION, BAD_DAY))


@query("profile_of_one_scan", sql(
    f"""SELECT 'overview' AS part, CAST(count(*) AS VARCHAR) AS name, {PCT} AS fail_pct FROM ev
        UNION ALL
        SELECT 'top_models', device_model, pct FROM (
            SELECT device_model, {PCT} AS pct FROM ev GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
        UNION ALL
        SELECT 'incident', CASE WHEN day = DATE '{BAD_DAY}' THEN 'bad day' ELSE 'other days' END, {PCT} FROM ev
        WHERE device_model = '{MODEL}' AND os_version = '{OS_VERSION}' GROUP BY 2"""))
def _(s, d):
    tables = ask.profile_events(device_events(s, d), MODEL, OS_VERSION, BAD_DAY)
    named = (("overview", F.col("rows").cast("string")), ("top_models", F.col("device_model")), ("incident", F.col("which")))
    parts = [tables[t].select(F.lit(t).alias("part"), name.alias("name"), "fail_pct") for t, name in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
