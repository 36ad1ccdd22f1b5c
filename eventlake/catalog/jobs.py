"""The daily job, from arrived CSV files to cleaned days."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog.base import BAD_DAY, RAW_COLUMNS, WEEK, between, built, query, sql
from eventlake.plans.daily_ingest import BadDay, compact_days, ingest_days
from eventlake.schemas import ARRIVAL_AUDIT, DAY_AUDIT
from eventlake.session import new_scratch
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import CSV_WRITE, device_events, read_layout
from eventlake.sources.runs import read_runs
from eventlake.streaming.arrivals import ingest_arrivals, ingest_arrivals_as_deltas


def _landed(s, d):
    path = f"{built(s, d, 'landing')}/landing"
    return path, hf.present_days(s, path)


@query("daily_ingest", sql(f"SELECT {RAW_COLUMNS}, conn, day FROM ev"))
def _(s, d):
    root = new_scratch(s, "ingest")
    path, days = _landed(s, d)
    ingest_days(s, path, root, days)
    return read_layout(s, root, "sorted")


@query("daily_ingest_one_day", sql(f"SELECT {RAW_COLUMNS}, conn, day FROM ev WHERE day = DATE '{BAD_DAY}'"))
def _(s, d):
    root = new_scratch(s, "ingest")
    ingest_days(s, _landed(s, d)[0], root, [BAD_DAY])
    return read_layout(s, root, "sorted")


@query("daily_ingest_audit", sql(
    f"""SELECT day AS date, count(*) + count(*) FILTER (WHERE event_id % 1000 = 0) AS rows_in,
               count(*) FILTER (WHERE event_id % 1000 = 0) AS duplicates_dropped, count(*) AS rows_out
        FROM ev WHERE {between(WEEK)} GROUP BY 1"""))
def _(s, d):
    root = new_scratch(s, "ingest")
    path, days = _landed(s, d)
    ingest_days(s, path, root, [x for x in days if WEEK[0] <= x <= WEEK[1]])
    return read_runs(s, f"{root}/ingest_runs", DAY_AUDIT).select(
        "date", "rows_in", "duplicates_dropped", "rows_out")


@query("ingest_of_arriving_files", sql("SELECT day, count(*) AS rows, count(conn) AS with_conn FROM ev GROUP BY 1"))
def _(s, d):
    root = new_scratch(s, "arrivals")
    ingest_arrivals(s, _landed(s, d)[0], root, f"{root}/_progress")
    return read_layout(s, root, "sorted").groupBy("day").agg(
        F.count("*").alias("rows"), F.count("conn").alias("with_conn"))


def _arrived_in_three_runs(s, d):
    """Two thirds of the events, then the others with some that were there before, then nothing new."""
    root = new_scratch(s, "deltas")
    events = device_events(s, d)
    late = F.col("event_id") % 3 == 0
    for rows in (events.where(~late), events.where(late | (F.col("event_id") % 10 == 0)), None):
        if rows is not None:
            (rows.hint("rebalance", "day").write.mode("append").options(**CSV_WRITE).option("compression", "gzip")
             .partitionBy("day").csv(f"{root}/landing"))
        ingest_arrivals_as_deltas(s, f"{root}/landing", root, f"{root}/_progress")
    return root


@query("arrivals_as_deltas", sql(f"SELECT {RAW_COLUMNS}, conn, day FROM ev"))
def _(s, d):
    return read_layout(s, _arrived_in_three_runs(s, d), "sorted")


@query("arrivals_as_deltas_compacted", sql(f"SELECT {RAW_COLUMNS}, conn, day FROM ev"))
def _(s, d):
    root = _arrived_in_three_runs(s, d)
    compact_days(s, root, hf.present_days(s, f"{root}/sorted"))
    return read_layout(s, root, "sorted")


@query("arrival_audit", sql(
    """SELECT day, count(*) + count(*) FILTER (WHERE event_id % 10 = 0 AND event_id % 3 <> 0) AS rows_in,
              count(*) AS added, count(*) FILTER (WHERE event_id % 10 = 0 AND event_id % 3 <> 0) AS known,
              false AS cleaned_whole
       FROM ev GROUP BY 1"""))
def _(s, d):
    runs = read_runs(s, f"{_arrived_in_three_runs(s, d)}/arrival_runs", ARRIVAL_AUDIT)
    return runs.groupBy("day").agg(
        F.sum("rows_in").alias("rows_in"), F.sum("added").alias("added"), F.sum("known").alias("known"),
        F.bool_or("cleaned_whole").alias("cleaned_whole"))


@query("daily_check", sql(
    f"""SELECT t.expected, day, count(*) AS rows, t.expected <> 'wrong' AS published
        FROM ev, (SELECT unnest(['wrong', 'right']) AS expected) t WHERE {between(WEEK)} GROUP BY ALL"""))
def _(s, d):
    """Days ingested with one expected row too many and with the right numbers: refused, then published."""
    path, days = _landed(s, d)
    week = [x for x in days if WEEK[0] <= x <= WEEK[1]]
    rows = device_events(s, d, *WEEK).groupBy("day").agg(F.count("*").alias("rows"))
    right = {r["day"]: r["rows"] for r in rows.collect()}
    outcomes = []
    for name, expected in (("wrong", right | {BAD_DAY: right[BAD_DAY] + 1}), ("right", right)):
        root = new_scratch(s, "ingest")
        try:
            ingest_days(s, path, root, week, expected_rows=expected)
        except BadDay:
            pass
        outcomes += [(name, x) for x in hf.present_days(s, f"{root}/sorted")]
    present = s.createDataFrame(outcomes, "expected string, day date").withColumn("published", F.lit(True))
    asked = rows.withColumn("expected", F.explode(F.array(F.lit("wrong"), F.lit("right"))))
    return asked.join(present, ["expected", "day"], "left").select(
        "expected", "day", "rows", F.coalesce("published", F.lit(False)).alias("published"))
