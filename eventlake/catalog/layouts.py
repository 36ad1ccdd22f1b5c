"""Writers read back, scans of each layout, and what their statistics say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventlake.catalog.base import (
    BAD_DAY,
    EC,
    ERRORS,
    EV,
    HEALTH,
    RAW_COLUMNS,
    WEEK,
    between,
    built,
    layout,
    query,
    row_groups,
    sql,
    zone_map,
)
from eventlake.functions import in_window
from eventlake.operators import layout_report as report
from eventlake.operators import scan_estimate as scan
from eventlake.operators.row_order import count_flips
from eventlake.plans import layouts as lay
from eventlake.plans import publish
from eventlake.plans import questions as ask
from eventlake.schemas import SCAN_STATS
from eventlake.session import new_scratch
from eventlake.sources import events as ev
from eventlake.sources import hadoop_files as hf
from eventlake.sources.files import files_read, list_files, with_row_position
from eventlake.sources.footers import read_row_groups
from eventlake.sources.runs import read_runs, track
from eventlake.sources.views import read_small_table, register_views

ALL_EVENTS = sql(f"SELECT {RAW_COLUMNS}, day FROM ev")
CLEAN_EVENTS = sql(f"SELECT {RAW_COLUMNS}, conn, day FROM ev")

# ---- each layout read back --------------------------------------------------------------------

query("layout_by_day", ALL_EVENTS)(lambda s, d: layout(s, d, "by_day"))
query("layout_sorted", CLEAN_EVENTS)(lambda s, d: layout(s, d, "sorted"))
query("layout_single", ALL_EVENTS)(lambda s, d: layout(s, d, "single"))
query("layout_csv", ALL_EVENTS)(lambda s, d: layout(s, d, "csv"))
query("layout_tiny_files", sql(
    f"SELECT {RAW_COLUMNS}, day, CAST(event_id % 50 AS INTEGER) AS chunk FROM ev"))(
    lambda s, d: layout(s, d, "tiny_files"))


@query("scan_week_of_day_folders", sql(
    f"SELECT event_id, status, day FROM ev WHERE {between(WEEK)}"))
def _(s, d):
    return layout(s, d, "by_day").where(in_window(*WEEK)).select("event_id", "status", "day")


@query("scan_one_day_without_day_column", sql(f"SELECT {RAW_COLUMNS} FROM ev WHERE day = DATE '{BAD_DAY}'"))
def _(s, d):
    return ev.read_one_day(s, built(s, d, "by_day"), "by_day", BAD_DAY)


@query("scan_csv_typed", sql(
    f"SELECT {RAW_COLUMNS}, day FROM ev UNION ALL SELECT {RAW_COLUMNS}, day FROM ev WHERE event_id % 1000 = 0"))
def _(s, d):
    return ev.read_landing(s, f"{built(s, d, 'landing')}/landing")


@query("scan_csv_inferred", sql(
    "SELECT event_id, CAST(error_code AS INTEGER) AS error_code, duration_ms, day FROM ev"))
def _(s, d):
    events = ev.read_csv_inferred(s, f"{built(s, d, 'csv')}/csv")
    return events.select(F.col("event_id").cast("bigint"), "error_code", "duration_ms", "day")


@query("files_of_a_week", sql(f"SELECT DISTINCT CAST(day AS VARCHAR) AS folder_day FROM ev WHERE {between(WEEK)}"))
def _(s, d):
    files = files_read(layout(s, d, "by_day").where(in_window(*WEEK)))
    return files.select(F.regexp_extract("file", r"day=([0-9-]+)", 1).alias("folder_day")).distinct()


@query("row_positions_in_files", sql("SELECT day, count(*) AS rows, true AS gapless FROM ev GROUP BY 1"))
def _(s, d):
    placed = with_row_position(layout(s, d, "by_day")).groupBy("day", "file").agg(
        F.count("*").alias("rows"), (F.max("row_index") + 1).alias("span"), F.min("row_index").alias("start"))
    return placed.groupBy("day").agg(
        F.sum("rows").alias("rows"),
        F.bool_and((F.col("rows") == F.col("span")) & (F.col("start") == 0)).alias("gapless"))


@query("status_flips_per_sorted_file", sql(
    "SELECT day, CAST(count(DISTINCT status) - 1 AS BIGINT) AS most_flips FROM ev GROUP BY 1"))
def _(s, d):
    flips = count_flips(layout(s, d, "sorted"), "status")
    day = F.to_date(F.regexp_extract("file", r"day=([0-9-]+)", 1))
    return flips.groupBy(day.alias("day")).agg(F.max("flips").alias("most_flips"))


@query("same_answer_in_each_layout", sql(
    f"""SELECT unnest(['csv', 'single', 'by_day', 'sorted', 'tiny_files']) AS layout, * FROM (
          SELECT count(*) FILTER (WHERE status = 'fail') AS failures,
                 count(DISTINCT device_id) FILTER (WHERE status = 'fail') AS devices
          FROM ev WHERE {between(WEEK)})"""))
def _(s, d):
    answers = []
    for name in ev.LAYOUTS:
        week = layout(s, d, name).where(in_window(*WEEK) & (F.col("status") == "fail"))
        answers.append(week.agg(F.count("*").alias("failures"),
                                F.countDistinct("device_id").alias("devices"))
                       .select(F.lit(name).alias("layout"), "failures", "devices"))
    return reduce(lambda a, b: a.unionByName(b), answers)


# ---- building, replacing, publishing ----------------------------------------------------------

@query("stored_rollup_daily_health", sql("SELECT * FROM health", EV, HEALTH))
def _(s, d):
    return read_small_table(s, built(s, d, "rollups"), "rollup_daily_health")


@query("stored_rollup_daily_errors", sql("SELECT * FROM errs", EV, ERRORS))
def _(s, d):
    return read_small_table(s, built(s, d, "rollups"), "rollup_daily_errors")


@query("stored_error_codes_used", sql(
    "SELECT code, meaning FROM ec WHERE code IN (SELECT error_code FROM ev)", EV, EC))
def _(s, d):
    codes = read_small_table(s, built(s, d, "error_codes"), "error_codes")
    used = ev.device_events(s, d).where("error_code IS NOT NULL").select("error_code").distinct()
    return codes.join(used, codes["code"] == used["error_code"], "left_semi")


@query("build_only_missing_days", sql(
    """SELECT day, count(*) AS rows, 0::BIGINT AS built_again FROM ev GROUP BY 1"""))
def _(s, d):
    root = new_scratch(s, "partial")
    events = ev.device_events(s, d)
    lay.write_by_day(events.where(in_window(*WEEK)), f"{root}/by_day")
    days = hf.present_days(s, f"{built(s, d, 'by_day')}/by_day")
    todo = lay.missing_days(s, root, "by_day", days)
    lay.write_by_day(events.where(F.col("day").isin(todo)), f"{root}/by_day", replace_days=True)
    again = len(lay.missing_days(s, root, "by_day", days))
    stored = ev.read_layout(s, root, "by_day").groupBy("day").agg(F.count("*").alias("rows"))
    return stored.withColumn("built_again", F.lit(again).cast("bigint"))


@query("build_layouts_whole", sql(
    """SELECT unnest(['by_day', 'sorted']) AS layout, count(*) AS rows FROM ev"""))
def _(s, d):
    root = new_scratch(s, "whole")
    lay.write_by_day(ev.device_events(s, d), f"{root}/by_day")
    lay.build_layouts(s, root)
    lay.build_layouts(s, root)      # nothing is left to do the second time
    counts = [ev.read_layout(s, root, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("layout"), "rows")
              for n in ("by_day", "sorted")]
    return counts[0].unionByName(counts[1])


@query("build_every_layout_twice", sql(
    f"""SELECT unnest(['by_day', 'sorted', 'tiny_files', 'single', 'csv', 'rollup_daily_health']) AS layout, count(*) AS rows,
               CAST(sum(duration_ms) AS BIGINT) AS total_ms FROM ev WHERE {between(WEEK)}"""))
def _(s, d):
    # the first build has one day less, and other rows of another day, than the second one
    root = new_scratch(s, "twice")
    events = ev.device_events(s, d, *WEEK).where(in_window(*WEEK))
    changed = events.where((F.col("day") < F.lit(BAD_DAY)) & ((F.col("day") > F.lit(WEEK[0])) | (F.col("event_id") % 2 == 0)))
    lay.write_by_day(changed, f"{root}/by_day")
    lay.build_layouts(s, root)
    lay.write_by_day(events.where(F.col("day").isin(WEEK[0], BAD_DAY)), f"{root}/by_day", replace_days=True)
    lay.build_layouts(s, root)
    rows = [ev.read_layout(s, root, n).agg(F.lit(n).alias("layout"), F.count("*").alias("rows"), F.sum("duration_ms").alias("total_ms")) for n in ev.LAYOUTS]
    rows.append(read_small_table(s, root, "rollup_daily_health").agg(F.lit("rollup_daily_health").alias("layout"), F.sum("events").alias("rows"), F.sum("total_duration_ms").alias("total_ms")))
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("replace_one_day", sql(
    f"""SELECT day, count(*) AS rows, CAST(sum(CASE WHEN day = DATE '{BAD_DAY}' THEN 0 ELSE duration_ms END)
               AS BIGINT) AS total_ms FROM ev GROUP BY 1"""))
def _(s, d):
    path = f"{new_scratch(s, 'replace')}/by_day"
    events = ev.device_events(s, d)
    lay.write_by_day(events, path)
    again = events.where(F.col("day") == F.lit(BAD_DAY)).withColumn("duration_ms", F.lit(0))
    lay.write_by_day(again, path, replace_days=True)
    stored = s.read.schema(ev.LAYOUTS["by_day"][1]).parquet(path)
    return stored.groupBy("day").agg(F.count("*").alias("rows"), F.sum("duration_ms").alias("total_ms"))


@query("publish_days", sql(f"SELECT day, count(*) AS rows FROM ev WHERE {between(WEEK)} GROUP BY 1"))
def _(s, d):
    root, target = built(s, d, "sorted"), new_scratch(s, "serving")
    days = [x for x in hf.present_days(s, f"{root}/sorted") if WEEK[0] <= x <= WEEK[1]]
    return publish.publish_days(s, root, target, days)


@query("publish_small_tables", sql(
    """SELECT 'rollup_daily_health' AS name, count(*) AS rows FROM health
       UNION ALL SELECT 'rollup_daily_errors', count(*) FROM errs
       UNION ALL SELECT 'error_codes', count(*) FROM ec""", EV, EC, HEALTH, ERRORS))
def _(s, d):
    root, target = built(s, d, "rollups", "error_codes"), new_scratch(s, "serving")
    done = publish.publish_small_tables(s, root, target)
    counts = [read_small_table(s, target, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
              for n in done]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("registered_views", sql(
    """SELECT unnest(['events', 'events_by_day', 'events_sorted']) AS view, count(*) AS rows FROM ev
       UNION ALL SELECT 'rollup_daily_health', count(*) FROM health
       UNION ALL SELECT 'rollup_daily_errors', count(*) FROM errs""", EV, HEALTH, ERRORS))
def _(s, d):
    register_views(s, built(s, d, "by_day", "sorted", "rollups"))
    names = ["events", "events_by_day", "events_sorted", "rollup_daily_health", "rollup_daily_errors"]
    return s.sql(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS rows FROM {n}" for n in names))


@query("run_log", sql("SELECT 'roll-ups' AS step, CAST(count(*) AS VARCHAR) AS scale, 'done' AS status FROM ev"))
def _(s, d):
    root = new_scratch(s, "runs")
    events = ev.device_events(s, d)
    with track(s, f"{root}/runs", "roll-ups", str(events.count())):
        lay.write_rollups(events, root)
    return read_runs(s, f"{root}/runs").select("step", "scale", "status")


# ---- sizes and scan estimates -----------------------------------------------------------------

@query("row_group_statistics", sql(
    """SELECT 'event_id' AS "column", min(event_id) AS lo, max(event_id) AS hi FROM ev
       UNION ALL SELECT 'device_id', min(device_id), max(device_id) FROM ev
       UNION ALL SELECT 'error_code', min(error_code), max(error_code) FROM ev
       UNION ALL SELECT 'duration_ms', min(duration_ms), max(duration_ms) FROM ev"""))
def _(s, d):
    stats = read_row_groups(s, f"{built(s, d, 'sorted')}/sorted")
    numbers = stats.where(F.col("column").isin("event_id", "device_id", "error_code", "duration_ms"))
    return numbers.groupBy("column").agg(F.min(F.col("lo").cast("bigint")).alias("lo"),
                                         F.max(F.col("hi").cast("bigint")).alias("hi"))


@query("layout_sizes", sql(
    """SELECT unnest(['by_day', 'sorted', 'single', 'csv']) AS layout, count(*) AS rows, true AS priced FROM ev"""))
def _(s, d):
    root = built(s, d, "by_day", "sorted", "single", "csv")
    rows = layout(s, d, "by_day").count()
    sizes = report.layout_sizes(report.layout_files(s, root), rows)
    wanted = sizes.where(F.col("layout").isin("by_day", "sorted", "single", "csv"))
    priced = (F.col("files") >= 1) & (F.col("mb") >= 0) & (F.col("bytes_per_row") > 0)
    return wanted.select("layout", F.lit(rows).cast("bigint").alias("rows"), priced.alias("priced"))


@query("listed_bytes_equal_read_bytes", sql(
    "SELECT unnest(['by_day', 'sorted']) AS layout, true AS agree"))
def _(s, d):
    root = built(s, d, "by_day", "sorted")
    listed = report.layout_files(s, root).groupBy("layout").agg(F.sum("length").alias("listed"))
    read = [layout(s, d, n).select(F.lit(n).alias("layout"), F.col("_metadata.file_path").alias("file"),
                                   F.col("_metadata.file_size").alias("size")).distinct()
            for n in ("by_day", "sorted")]
    sizes = read[0].unionByName(read[1]).groupBy("layout").agg(F.sum("size").alias("read"))
    return sizes.join(listed, "layout").select("layout", (F.col("read") == F.col("listed")).alias("agree"))


def _days_kept(s, d, name, columns, filters):
    stats = row_groups(s, d, name)
    kept = scan.kept_row_groups(stats, columns, filters)
    day = F.regexp_extract("file", r"day=([0-9-]+)", 1)
    return kept.select(day.alias("folder_day")).distinct()


@query("estimate_opens_one_day", f"SELECT '{BAD_DAY}' AS folder_day WHERE EXISTS (SELECT 1 FROM events)")
def _(s, d):
    return _days_kept(s, d, "by_day", ["day", "status"],
                      {"day": (BAD_DAY, BAD_DAY), "status": ("fail", "fail")})


@query("estimate_opens_seven_days", sql(
    f"""SELECT DISTINCT CAST(day AS VARCHAR) AS folder_day FROM ev WHERE {between(WEEK)} AND status = 'fail'"""))
def _(s, d):
    return _days_kept(s, d, "by_day", ["day", "status", "error_code"],
                      {"day": WEEK, "status": ("fail", "fail")})


@query("estimate_by_zone_map", sql(
    f"""SELECT day, true AS same_bytes FROM (SELECT DISTINCT CAST(day AS VARCHAR) AS day FROM ev WHERE {between(WEEK)} AND status = 'fail')"""))
def _(s, d):
    asked = ["day", "status", "error_code"], {"day": WEEK, "status": ("fail", "fail")}
    zones = zone_map(s, d).kept_row_groups(*asked).withColumnRenamed("bytes", "zone_bytes")
    every = scan.kept_row_groups(row_groups(s, d, "by_day"), *asked)
    day = F.regexp_extract("file", r"day=([0-9-]+)", 1)
    both = zones.join(every, ["file", "row_group"], "full").withColumn("day", day)
    return both.groupBy("day").agg(F.bool_and(F.col("zone_bytes").eqNullSafe(F.col("bytes"))).alias("same_bytes"))


@query("estimate_against_bounds", sql(
    """SELECT DISTINCT CAST(day AS VARCHAR) AS folder_day FROM ev GROUP BY day
       HAVING min(device_id) <= 9 AND max(device_id) >= 3 AND min(error_code) <= 1010"""))
def _(s, d):
    # at this size a day is one row group, so the estimate has to agree with the bounds per day
    return _days_kept(s, d, "by_day", ["device_id"], {"device_id": (3, 9), "error_code": (1000, 1010)})


def _derived_stats(s, d):
    """Statistics as a footer would hold them: a file per ship year, a row group per line number,
    and the columns of order lines as text bounds."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    file = F.concat(F.lit("t/day="), F.date_format("l_shipdate", "yyyy"), F.lit("-01-01/f"))
    late = F.when(F.col("l_linenumber") > 4, F.col("l_partkey"))
    columns = {"part": F.col("l_partkey"), "late": late, "flag": F.col("l_returnflag")}
    groups = lines.groupBy(file.alias("file"), F.col("l_linenumber").alias("row_group")).agg(
        F.count("*").alias("bytes"),
        *[m(c).alias(f"{name}_{end}") for name, c in columns.items() for end, m in (("lo", F.min), ("hi", F.max))])
    chunks = F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"{name}_lo").cast("string").alias("lo"),
                 F.col(f"{name}_hi").cast("string").alias("hi"), F.col("bytes").alias("bytes"),
                 F.col(f"{name}_lo").isNull().alias("all_null")) for name in columns])
    return groups.select("file", "row_group", F.inline(chunks)).select(*SCAN_STATS.fieldNames())


@query("scan_estimate", """
    WITH g AS (SELECT year(l_shipdate) AS y, l_linenumber AS n, count(*) AS bytes,
                      min(l_partkey) AS lo, max(l_partkey) AS hi, min(l_returnflag) AS flo,
                      max(l_returnflag) AS fhi FROM lineitem GROUP BY 1, 2)
    SELECT CAST(coalesce(sum(2 * bytes), 0) AS BIGINT) AS bytes, count(DISTINCT y) AS files FROM g
    WHERE n > 4 AND lo <= 900 AND hi >= 90 AND flo <= 'O' AND fhi >= 'B'
      AND y BETWEEN 1993 AND 1996""")
def _(s, d):
    filters = {"late": (90, 900), "flag": ("B", "O"), "day": ("1993-01-01", "1996-12-31"),
               "no_such_column": (1, 2)}
    return scan.estimate_scan(_derived_stats(s, d), ["part", "flag"], filters)


@query("whole_file_cost", sql("SELECT true AS grows, count(*) AS rows FROM ev"))
def _(s, d):
    cost = scan.whole_file_cost(list_files(s, f"{built(s, d, 'csv')}/csv"))
    rows = layout(s, d, "csv").agg(F.count("*").alias("rows"))
    one = cost.withColumn("one", F.lit(1)).join(rows.withColumn("one", F.lit(1)), "one")
    return one.select((F.col("bytes") > F.col("rows") * 50).alias("grows"), "rows")


@query("whole_file_cost_of_rollups", sql(
    """SELECT 'rollup_daily_health' AS layout, count(*) AS rows, true AS as_read, true AS billed FROM health
       UNION ALL SELECT 'rollup_daily_errors', count(*), true, true FROM errs""", EV, HEALTH, ERRORS))
def _(s, d):
    """Bytes and files of the roll-ups by their listing, against the files that a whole read meets."""
    root = built(s, d, "rollups")
    met = []
    for name in ("rollup_daily_health", "rollup_daily_errors"):
        per_file = read_small_table(s, root, name).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"))
        met.append(per_file.agg(F.lit(name).alias("layout"), F.sum("n").alias("rows"), F.sum("file_size").alias("size"), F.count("*").alias("met")))
    cost = scan.whole_file_cost_per_layout(report.layout_files(s, root))
    billed = F.abs(F.col("usd_per_1000") - F.greatest(F.col("bytes") / 1e6, F.lit(10.0)) * 0.005) < 1e-9
    return met[0].unionByName(met[1]).join(cost, "layout").select(
        "layout", "rows", ((F.col("size") == F.col("bytes")) & (F.col("met") == F.col("files"))).alias("as_read"), billed.alias("billed"))


# ---- measurement tables -----------------------------------------------------------------------

MEASURED_SQL = """m AS (
    SELECT event_type AS question, device_model AS layout, count(*) AS rows,
           CAST(sum(duration_ms) AS DOUBLE) AS ms, CAST(sum(duration_ms) AS DOUBLE) / 1000 AS mb
    FROM ev GROUP BY 1, 2)"""


def _measured(s, d):
    return ev.device_events(s, d).groupBy(
        F.col("event_type").alias("question"), F.col("device_model").alias("layout")).agg(
        F.count("*").alias("rows"), F.sum("duration_ms").cast("double").alias("ms"),
        (F.sum("duration_ms").cast("double") / 1000).alias("mb"))


@query("price_per_1000_queries", sql(
    """SELECT question, layout, greatest(mb, 10) / 1e6 * 5 * 1000 AS usd FROM m""", EV, MEASURED_SQL))
def _(s, d):
    return _measured(s, d).select("question", "layout", scan.usd_per_1000(F.col("mb")).alias("usd"))


@query("projection_to_target_rows", sql(
    """SELECT question, layout, 1000000000::BIGINT AS rows, ms * (1e9::DOUBLE / rows) AS ms,
              mb * (1e9::DOUBLE / rows) AS mb FROM m""", EV, MEASURED_SQL))
def _(s, d):
    return report.project_to(_measured(s, d), 1_000_000_000, ["ms", "mb"])


@query("question_by_layout", sql(
    """SELECT question, max(ms) FILTER (WHERE layout = 'KR-10') AS "KR-10",
              max(ms) FILTER (WHERE layout = 'DX-100') AS "DX-100" FROM m GROUP BY 1""", EV, MEASURED_SQL))
def _(s, d):
    return report.pivot_measure(_measured(s, d), "ms", ["KR-10", "DX-100"])


@query("growth_by_row_count", sql(
    """SELECT rows, max(ms) FILTER (WHERE question = 'error') AS failures,
              max(ms) FILTER (WHERE question = 'view' AND layout = 'KR-10') AS kr10_views
       FROM m GROUP BY 1""", EV, MEASURED_SQL))
def _(s, d):
    series = {"failures": F.col("question") == "error",
              "kr10_views": (F.col("question") == "view") & (F.col("layout") == "KR-10")}
    return report.growth_series(_measured(s, d), "ms", series)


@query("failures_from_tiny_files", sql(
    f"SELECT count(*) AS failures FROM ev WHERE day = DATE '{BAD_DAY}' AND status = 'fail'"))
def _(s, d):
    return ask.failures_one_day(layout(s, d, "tiny_files"), BAD_DAY)


@query("failures_from_csv", sql(
    f"SELECT count(*) AS failures FROM ev WHERE day = DATE '{BAD_DAY}' AND status = 'fail'"))
def _(s, d):
    return ask.failures_one_day(layout(s, d, "csv"), BAD_DAY)
