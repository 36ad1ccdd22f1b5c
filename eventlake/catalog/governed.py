"""Governed reads over the cleaned layer and the roll-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from eventlake.catalog.base import (
    BAD_DAY,
    DEVICE,
    EC,
    EV,
    FIRST_DAY,
    HEALTH,
    WEEK,
    between,
    built,
    layout,
    query,
    row_groups,
    sql,
)
from eventlake.fixed_values import SCAN_BUDGET_MB
from eventlake.plans.governed import (
    Aggregate,
    Filter,
    GovernedReader,
    JsonField,
    Request,
    Source,
    audit,
)
from eventlake.sources.views import SMALL_TABLES, read_small_table

FAILED = Filter("status", "=", "fail")
COUNT = Aggregate("count", None, "n")
WEEK_EVENTS = Source("events", *WEEK, filters=[FAILED])
DAY_EVENTS = Source("events", BAD_DAY, BAD_DAY, filters=[FAILED])


def reader(s, d, small=tuple(SMALL_TABLES), **limits) -> GovernedReader:
    """A reader of the events and of small tables, of which only the named ones have to be built."""
    root = built(s, d, "sorted", *dict.fromkeys("rollups" if n.startswith("rollup") else n for n in small))
    tables = {n: read_small_table(s, root, n) for n in small}
    tables["events"] = layout(s, d, "sorted")
    limits.setdefault("budget_mb", 1e9)     # the test tables grow, the default budget does not
    return GovernedReader(s, tables, row_groups(s, d, "sorted"), **limits)


def _answer(s, d, request):
    named = {source.table for source in (request.source, request.join) if source is not None}
    answer = reader(s, d, [n for n in SMALL_TABLES if n in named]).run(request)
    if answer.df is None:
        raise RuntimeError(answer.note)
    return answer.df


@query("governed_failures_per_day", sql(
    f"SELECT day, count(*) AS n FROM ev WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1"))
def _(s, d):
    return _answer(s, d, Request(WEEK_EVENTS, {"day": "day"}, [COUNT], order_by=[("day", False)]))


@query("governed_failures_per_day_rollup", sql(
    f"SELECT day, count(*) AS n FROM ev WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1"))
def _(s, d):
    source = Source("rollup_daily_health", *WEEK, filters=[FAILED])
    return _answer(s, d, Request(source, {"day": "day"}, [Aggregate("sum", "events", "n")]))


@query("governed_what_broke", sql(
    f"""SELECT device_model, os_version, meaning, count(*) AS n FROM ev JOIN ec ON code = error_code
        WHERE day = DATE '{BAD_DAY}' AND status = 'fail' GROUP BY 1, 2, 3
        ORDER BY n DESC, 1, 2, 3 LIMIT 3""", EV, EC))
def _(s, d):
    keys = {c: c for c in ("device_model", "os_version", "meaning")}
    return _answer(s, d, Request(
        DAY_EVENTS, keys, [COUNT], Source("error_codes"), [("error_code", "code")],
        [("n", True), ("device_model", False), ("os_version", False), ("meaning", False)], 3))


@query("governed_json_field", sql(
    f"""SELECT conn, count(*) AS n, count(DISTINCT device_id) AS devices, min(duration_ms) AS least,
               max(duration_ms) AS most, round(avg(duration_ms), 6) AS mean
        FROM ev WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1"""))
def _(s, d):
    measures = [COUNT, Aggregate("count_distinct", "device_id", "devices"),
                Aggregate("min", "duration_ms", "least"), Aggregate("max", "duration_ms", "most"),
                Aggregate("avg", "duration_ms", "mean")]
    df = _answer(s, d, Request(WEEK_EVENTS, {"conn": JsonField("payload", "conn")}, measures))
    return df.withColumn("mean", F.round("mean", 6))


@query("governed_self_join", sql(
    f"""SELECT count(*) AS n, count(DISTINCT device_id) AS devices,
               CAST(sum(a.duration_ms) AS BIGINT) AS ms
        FROM ev a JOIN ev b USING (device_id)
        WHERE a.day = DATE '{WEEK[0]}' AND b.day = DATE '{BAD_DAY}'"""))
def _(s, d):
    return _answer(s, d, Request(
        Source("events", WEEK[0], WEEK[0]), {},
        [COUNT, Aggregate("count_distinct", "l.device_id", "devices"), Aggregate("sum", "l.duration_ms", "ms")],
        Source("events", BAD_DAY, BAD_DAY), [("device_id", "device_id")]))


@query("governed_latest_of_device", sql(
    f"""SELECT event_ts, event_type, status FROM ev WHERE device_id = {DEVICE} AND {between(WEEK)}
        ORDER BY event_ts DESC LIMIT 1000"""))
def _(s, d):
    source = Source("events", *WEEK, filters=[Filter("device_id", "=", DEVICE)])
    names = {c: c for c in ("event_ts", "event_type", "status")}
    return _answer(s, d, Request(source, names, order_by=[("event_ts", True)]))


@query("governed_union", sql(
    f"""SELECT device_model, count(*) AS n FROM ev WHERE day = DATE '{WEEK[0]}' AND status = 'fail' GROUP BY 1
        UNION SELECT device_model, count(*) FROM ev WHERE day = DATE '{BAD_DAY}' AND status = 'fail' GROUP BY 1"""))
def _(s, d):
    arms = [Request(Source("events", day, day, [FAILED]), {"device_model": "device_model"}, [COUNT])
            for day in (WEEK[0], BAD_DAY)]
    return reader(s, d).run_union(*arms).df


def attempts() -> list[Request]:
    """Requests good and bad, as a caller in a hurry would send them."""
    day = Source("events", BAD_DAY, BAD_DAY)
    return [
        Request(Source("secrets"), {"n": "n"}, label="a table that is not approved"),
        Request(Source("events"), every_column=True, label="all columns, no window"),
        Request(Source("events", first=BAD_DAY), {}, [COUNT], label="window without an end"),
        Request(Source("events", FIRST_DAY, date(2024, 3, 30)), {}, [COUNT], label="ninety days of events"),
        Request(day, every_column=True, label="whole rows of one day"),
        Request(day, {}, [Aggregate("collect_list", "payload", "p")], label="many rows in one value"),
        Request(day, {}, [COUNT], Source("events"), [("device_id", "device_id")],
                label="second copy without a window"),
        Request(day, {"x": "no_such_column"}, label="a column that is not there"),
        Request(Source("rollup_daily_health", *WEEK, filters=[FAILED]), {"day": "day"},
                [Aggregate("sum", "events", "failures")], label="weekly failures from the roll-up"),
        Request(WEEK_EVENTS, {"day": "day"}, [COUNT], label="weekly failures from events"),
        Request(Source("error_codes"), every_column=True, limit=5, label="small table, whole rows"),
        Request(WEEK_EVENTS, {"device_model": "device_model"}, [COUNT], limit=99999, label="limit too high"),
    ]


@query("governed_audit", sql(
    f"""SELECT tried, 'refused' AS verdict, 0::BIGINT AS row_count FROM (SELECT unnest([
            'a table that is not approved', 'all columns, no window', 'window without an end',
            'ninety days of events', 'whole rows of one day', 'many rows in one value',
            'second copy without a window', 'a column that is not there']) AS tried)
        UNION ALL SELECT 'weekly failures from the roll-up', 'ok', count(DISTINCT day) FROM health
            WHERE {between(WEEK)} AND status = 'fail'
        UNION ALL SELECT 'weekly failures from events', 'ok', count(DISTINCT day) FROM ev
            WHERE {between(WEEK)} AND status = 'fail'
        UNION ALL SELECT 'small table, whole rows', 'ok', 5
        UNION ALL SELECT 'limit too high', 'ok', count(DISTINCT device_model) FROM ev
            WHERE {between(WEEK)} AND status = 'fail'""", EV, HEALTH))
def _(s, d):
    return audit(reader(s, d), attempts()).select("tried", "verdict", "row_count")


@query("governed_over_budget", "SELECT 'refused' AS verdict, count(*) > 0 AS has_rows FROM events")
def _(s, d):
    request = Request(Source("events", *WEEK), {"device_id": "device_id", "payload": "payload"},
                      label="json column of a week")
    verdict = audit(reader(s, d, budget_mb=0.001), [request])
    any_row = layout(s, d, "sorted").agg((F.count("*") > 0).alias("has_rows"), F.lit("json column of a week").alias("tried"))
    return verdict.join(any_row, "tried").select("verdict", "has_rows")


@query("governed_result_too_large", "SELECT 'refused' AS verdict, count(*) > 0 AS has_rows FROM events")
def _(s, d):
    request = Request(Source("events", *WEEK), {"device_id": "device_id", "payload": "payload"}, limit=500,
                      label="many wide rows")
    verdict = audit(reader(s, d, max_result_kb=1), [request])
    any_row = layout(s, d, "sorted").agg((F.count("*") > 0).alias("has_rows"), F.lit("many wide rows").alias("tried"))
    return verdict.join(any_row, "tried").select("verdict", "has_rows")


@query("governed_default_budget", sql(
    f"SELECT day, count(*) AS n FROM ev WHERE {between(WEEK)} AND status = 'fail' GROUP BY 1"))
def _(s, d):
    request = Request(WEEK_EVENTS, {"day": "day"}, [COUNT], order_by=[("day", False)])
    answer = reader(s, d, budget_mb=SCAN_BUDGET_MB).run(request)
    if answer.df is None:
        raise RuntimeError(answer.note)
    return answer.df


@query("governed_union_over_budget", "SELECT 'refused' AS verdict, count(*) > 0 AS has_rows FROM events")
def _(s, d):
    arm = Request(Source("events", *WEEK), {"device_id": "device_id"}, limit=5)
    mb = reader(s, d).scan_mb(arm)
    answer = reader(s, d, budget_mb=1.5 * mb).run_union(arm, arm)
    return layout(s, d, "sorted").agg(F.lit(answer.status).alias("verdict"), (F.count("*") > 0).alias("has_rows"))


@query("governed_union_too_many_rows", sql(
    f"""SELECT CASE WHEN count(DISTINCT event_id) > 50 THEN 'refused' ELSE 'ok' END AS verdict FROM ev
        WHERE day IN (DATE '{WEEK[0]}', DATE '{BAD_DAY}')"""))
def _(s, d):
    arms = [Request(Source("events", day, day), {"event_id": "event_id"}) for day in (WEEK[0], BAD_DAY)]
    answer = reader(s, d, max_rows=50).run_union(*arms)
    return layout(s, d, "sorted").agg(F.lit(answer.status).alias("verdict"))
