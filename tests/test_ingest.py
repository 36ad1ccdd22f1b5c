from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.catalog.base import land
from eventlake.operators.compare import same_answer
from eventlake.operators.dedupe import latest_per_key, one_per_key
from eventlake.plans import layouts as lay
from eventlake.plans.daily_ingest import BadDay, add_arrivals, clean, compact_days, ingest_days
from eventlake.plans.publish import publish_days, publish_small_tables
from eventlake.schemas import ARRIVAL_AUDIT, DAY_AUDIT, EVENT_CLEAN
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import CSV_WRITE, device_events, read_landing, read_layout
from eventlake.sources.files import list_files
from eventlake.sources.runs import read_runs, track
from eventlake.sources.views import read_small_table
from eventlake.streaming.arrivals import ingest_arrivals, ingest_arrivals_as_deltas

DAYS = [date(2024, 1, d) for d in (1, 2, 3)]


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return device_events(spark, sf_dir, DAYS[0], DAYS[-1])


@pytest.fixture(scope="module")
def landing(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landing"))
    again = events.where("event_id % 10 = 0")
    (events.unionByName(again).repartition("day").write.mode("overwrite").options(**CSV_WRITE)
     .option("compression", "gzip").partitionBy("day").csv(path))
    return path


def test_resent_events_are_dropped_and_counted(spark, events, landing, tmp_path):
    audit = {r["date"]: r for r in ingest_days(spark, landing, str(tmp_path), DAYS).collect()}
    for day in DAYS:
        own = events.where(F.col("day") == F.lit(day))
        resent = own.where("event_id % 10 = 0").count()
        assert audit[day]["rows_out"] == own.count()
        assert audit[day]["duplicates_dropped"] == resent > 0
    logged = read_runs(spark, f"{tmp_path}/ingest_runs", DAY_AUDIT)
    assert {r["date"]: r["rows_in"] for r in logged.collect()} == {d: a["rows_in"] for d, a in audit.items()}


def test_csv_route_and_parquet_route_agree(spark, events, landing, tmp_path):
    ingest_days(spark, landing, str(tmp_path / "a"), DAYS[:1])
    lay.write_sorted(lay.with_conn(events.where(F.col("day") == F.lit(DAYS[0]))), f"{tmp_path}/b/sorted")
    via_csv = spark.read.parquet(f"{tmp_path}/a/sorted")
    via_parquet = spark.read.parquet(f"{tmp_path}/b/sorted")
    assert via_csv.dtypes == via_parquet.dtypes
    assert same_answer(via_csv, via_parquet)


def test_reingest_replaces_only_that_day(spark, landing, tmp_path):
    root = str(tmp_path)
    ingest_days(spark, landing, root, DAYS)
    before = {r["path"] for r in list_files(spark, f"{root}/sorted").collect()}
    ingest_days(spark, landing, root, [DAYS[1]])
    after = {r["path"] for r in list_files(spark, f"{root}/sorted").collect()}
    assert {p.split("day=")[1][:10] for p in before ^ after} == {str(DAYS[1])}
    assert hf.present_days(spark, f"{root}/sorted") == DAYS
    assert hf.child_names(spark, f"{root}/_incoming") == []


def test_unexpected_row_count_publishes_nothing(spark, landing, tmp_path):
    root = str(tmp_path)
    with pytest.raises(BadDay, match="2024-01-02"):
        ingest_days(spark, landing, root, DAYS, expected_rows={DAYS[1]: 7})
    assert hf.present_days(spark, f"{root}/sorted") == []


def test_days_that_never_arrived_are_named(spark, landing, tmp_path):
    with pytest.raises(FileNotFoundError, match="2024-02-01"):
        ingest_days(spark, landing, str(tmp_path), [DAYS[0], date(2024, 2, 1)])


def test_a_value_of_the_wrong_type_stops_the_job(spark, tmp_path):
    folder = tmp_path / "landing" / "day=2024-01-01"
    folder.mkdir(parents=True)
    names = ",".join(f.name for f in EVENT_CLEAN.fields if f.name not in ("conn", "day"))
    (folder / "e.csv").write_text(names + "\nnot-a-number,2024-01-01,2024-01-01,1,m,o,f,c,t,,ok,5,{}\n")
    with pytest.raises(Exception, match="MALFORMED|NumberFormat"):
        ingest_days(spark, str(tmp_path / "landing"), str(tmp_path / "root"), DAYS[:1])
    assert hf.present_days(spark, str(tmp_path / "root" / "sorted")) == []


def test_same_id_on_two_days_survives(spark, events):
    day = F.lit(DAYS[1])
    two = events.where(F.col("day") == F.lit(DAYS[0])).limit(1)
    both = two.unionByName(two.withColumn("day", day)).unionByName(two)
    assert clean(both).count() == 2


def test_one_per_key_always_keeps_the_same_row(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    for n in (1, 7):
        kept = one_per_key(df.repartition(n), ["k"]).collect()
        assert sorted((r["k"], r["v"]) for r in kept) == [(i, i) for i in range(10)]


def test_one_hot_key_is_reduced_before_the_shuffle(spark):
    # all rows share one key; each map task must send a single row
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") % 1).alias("k"), F.col("id").alias("v"))
    latest = latest_per_key(df, "k", "v")
    assert latest.collect()[0]["v"] == 199_999
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    plan = one_per_key(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_single_day_needs_one_shuffle_of_rows(spark, landing):
    arrived = read_landing(spark, landing).where(F.col("day").isin(DAYS[:1]))
    ordered = lay.in_layout_order(clean(arrived))
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_arrivals_are_picked_up_once_and_late_files_too(spark, events, tmp_path):
    landing, root, progress = (str(tmp_path / n) for n in ("landing", "root", "progress"))
    early = events.where(F.col("day") < F.lit(DAYS[2]))
    half = F.col("event_id") % 2 == 0
    land(early.where(half | (F.col("day") == F.lit(DAYS[0]))), landing)
    assert ingest_arrivals(spark, landing, root, progress) == 1
    assert ingest_arrivals(spark, landing, root, progress) == 0
    rest = events.where(~half & (F.col("day") == F.lit(DAYS[1])))
    (rest.write.mode("append").options(**CSV_WRITE).option("compression", "gzip").partitionBy("day").csv(landing))
    touched = []
    assert ingest_arrivals(spark, landing, root, progress, after=touched.extend) == 1
    assert touched == [DAYS[1]]
    assert same_answer(read_layout(spark, root, "sorted").drop("conn"), early)


def test_publish(spark, landing, tmp_path):
    root, target = str(tmp_path / "root"), str(tmp_path / "serving")
    ingest_days(spark, landing, root, DAYS)
    lay.write_rollups(read_layout(spark, root, "sorted"), root)
    publish_days(spark, root, target, DAYS)
    again = publish_days(spark, root, target, [DAYS[1]])
    assert [r["day"] for r in again.collect()] == [DAYS[1]]
    assert same_answer(read_layout(spark, target, "sorted"), read_layout(spark, root, "sorted"))
    assert publish_small_tables(spark, root, target) == ["rollup_daily_health", "rollup_daily_errors"]
    with pytest.raises(FileNotFoundError, match="2024-03-01"):
        publish_days(spark, root, target, [date(2024, 3, 1)])


def test_rollups_of_touched_days_are_refreshed(spark, events, tmp_path):
    root = str(tmp_path)
    lay.write_rollups(events, root)
    changed = events.where(F.col("event_id") % 2 == 0)
    lay.write_rollups(changed, root, days=[DAYS[1]])
    stored = spark.read.parquet(f"{root}/rollups/rollup_daily_health")
    got = {r["day"]: r["n"] for r in stored.groupBy("day").agg(F.sum("events").alias("n")).collect()}
    want = {r["day"]: r["count"] for r in events.groupBy("day").count().collect()}
    want[DAYS[1]] = changed.where(F.col("day") == F.lit(DAYS[1])).count()
    assert got == want


def test_failed_steps_are_logged_too(spark, tmp_path):
    path = str(tmp_path / "runs")
    with track(spark, path, "good", "10M"):
        pass
    with pytest.raises(ValueError), track(spark, path, "bad", "10M"):
        raise ValueError("no")
    rows = {r["step"]: r for r in read_runs(spark, path).collect()}
    assert rows["good"]["status"] == "done" and rows["good"]["error"] is None
    assert rows["bad"]["status"] == "failed" and "no" in rows["bad"]["error"]


def test_nothing_stale_is_left_of_a_day_that_lost_its_rows(spark, events, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    land(events, landing)
    ingest_days(spark, landing, root, DAYS, refresh_rollups=True)
    # the day arrives again: one day without failures, another one without any event
    calm = events.where((F.col("day") == F.lit(DAYS[0])) & (F.col("status") == "ok")).drop("day")
    calm.write.mode("overwrite").options(**CSV_WRITE).csv(f"{landing}/day={DAYS[0]}")
    names = ",".join(f.name for f in EVENT_CLEAN.fields if f.name not in ("conn", "day"))
    folder = tmp_path / "landing" / f"day={DAYS[1]}"
    for old in folder.iterdir():
        old.unlink()
    (folder / "empty.csv").write_text(names + "\n")
    audit = {r["date"]: r for r in ingest_days(spark, landing, root, DAYS[:2], refresh_rollups=True).collect()}
    assert audit[DAYS[1]]["rows_in"] == audit[DAYS[1]]["rows_out"] == 0
    assert hf.present_days(spark, f"{root}/sorted") == [DAYS[0], DAYS[2]]
    for name, days in (("rollup_daily_errors", {DAYS[2]}), ("rollup_daily_health", {DAYS[0], DAYS[2]})):
        assert {r["day"] for r in read_small_table(spark, root, name).select("day").distinct().collect()} == days


def test_late_files_with_an_old_time_are_ingested(spark, events, tmp_path):
    import os
    import time
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    land(events.where(F.col("day") == F.lit(DAYS[0])), landing)
    ingest_arrivals(spark, landing, root, f"{root}/_progress")
    land(events.where(F.col("day") == F.lit(DAYS[1])), str(tmp_path / "more"))
    os.rename(tmp_path / "more" / f"day={DAYS[1]}", tmp_path / "landing" / f"day={DAYS[1]}")
    old = time.time() - 30 * 86400
    for f in (tmp_path / "landing" / f"day={DAYS[1]}").iterdir():
        os.utime(f, (old, old))
    assert ingest_arrivals(spark, landing, root, f"{root}/_progress") == 1
    assert hf.present_days(spark, f"{root}/sorted") == DAYS[:2]


def test_other_headers_are_refused(spark, events, tmp_path):
    """Columns in another order must not be read by position."""
    folder = tmp_path / "landing" / f"day={DAYS[0]}"
    one = events.where(F.col("day") == F.lit(DAYS[0])).drop("day")
    swapped = ["os_version" if c == "device_model" else "device_model" if c == "os_version" else c for c in one.columns]
    one.select(*swapped).write.options(**CSV_WRITE).csv(str(folder))
    with pytest.raises(Exception, match="(?i)header"):
        ingest_days(spark, str(tmp_path / "landing"), str(tmp_path / "root"), [DAYS[0]])
    assert hf.present_days(spark, f"{tmp_path}/root/sorted") == []


def test_arrived_lines_are_counted_as_the_csv_reader_sees_them(spark, landing, tmp_path):
    from eventlake.sources.events import count_landing

    def by_reader(path):
        rows = read_landing(spark, path).groupBy("day").agg(
            F.count("*").alias("rows_in"), F.countDistinct("event_id").alias("ids_in"))
        return sorted(map(tuple, rows.collect()))

    assert sorted(map(tuple, count_landing(spark, landing, DAYS).collect())) == by_reader(landing)
    # quoted ids, blank lines, Windows line ends, a header in each file
    names = ",".join(f.name for f in EVENT_CLEAN.fields if f.name not in ("conn", "day"))
    line = '"%s",2024-01-01 00:00:00,2024-01-01 00:00:00,1,m,o,f,c,t,,ok,5,"{""conn"":""usb,x""}"'
    folder = tmp_path / "day=2024-01-01"
    folder.mkdir()
    (folder / "a.csv").write_text("\r\n".join([names, line % 1, line % 2, "", line % 1, ""]))
    (folder / "b.csv").write_text("\n".join(['"' + names.replace(",", '","') + '"', line % 3]) + "\n")
    got = [tuple(r) for r in count_landing(spark, str(tmp_path), DAYS[:1]).collect()]
    assert got == by_reader(str(tmp_path)) == [(DAYS[0], 4, 3)]


def by_folder(events, path):
    """CSV files in day folders, appended beside those that are there."""
    events.write.mode("append").options(**CSV_WRITE).option("compression", "gzip").partitionBy("day").csv(path)


def test_deltas_give_what_cleaning_whole_gives(spark, events, tmp_path):
    landing, root, progress = (str(tmp_path / n) for n in ("landing", "root", "progress"))
    odd = F.col("event_id") % 2 == 1
    by_folder(events.where(odd & (F.col("day") != F.lit(DAYS[2]))), landing)
    assert ingest_arrivals_as_deltas(spark, landing, root, progress, refresh_rollups=True) == 1
    assert ingest_arrivals_as_deltas(spark, landing, root, progress) == 0
    stood = {r["path"] for r in list_files(spark, f"{root}/sorted").collect()}

    # late events of one day, a new day, re-sent events of another day; twice in the same batch
    late = events.where((~odd & (F.col("day") == F.lit(DAYS[1]))) | (F.col("day") == F.lit(DAYS[2])))
    again = events.where(odd & (F.col("day") == F.lit(DAYS[0])))
    by_folder(late.unionByName(again).unionByName(again), landing)
    assert ingest_arrivals_as_deltas(spark, landing, root, progress, refresh_rollups=True) == 1
    now = {r["path"] for r in list_files(spark, f"{root}/sorted").collect()}
    assert stood < now  # what stood was not written again
    assert not any(f"day={DAYS[0]}" in p for p in now - stood)

    whole = str(tmp_path / "whole")
    ingest_days(spark, landing, whole, DAYS, refresh_rollups=True)
    assert same_answer(read_layout(spark, root, "sorted"), read_layout(spark, whole, "sorted"))
    for name in ("rollup_daily_health", "rollup_daily_errors"):
        a, b = (read_small_table(spark, r, name) for r in (root, whole))
        assert same_answer(a.drop("month"), b.drop("month"))
    runs = {(r["day"], r["added"] > 0): r for r in read_runs(spark, f"{root}/arrival_runs", ARRIVAL_AUDIT).collect()}
    n = again.count()
    assert (runs[DAYS[0], False]["rows_in"], runs[DAYS[0], False]["repeats"], runs[DAYS[0], False]["known"]) == (2 * n, n, n)
    assert hf.child_names(spark, f"{root}/_incoming") == []


@pytest.mark.parametrize("change", [-1, 1])
def test_a_resent_event_that_differs(spark, events, tmp_path, change):
    """Whichever of the two comes first in the order of the de-duplication stays, as if both had come at once."""
    landing, root, progress = (str(tmp_path / n) for n in ("landing", "root", "progress"))
    day = events.where(F.col("day") == F.lit(DAYS[0]))
    by_folder(day, landing)
    ingest_arrivals_as_deltas(spark, landing, root, progress)
    by_folder(day.where("event_id % 7 = 0").withColumn("device_id", F.col("device_id") + change).unionByName(
        day.where("event_id % 7 = 1").withColumn("error_code", F.lit(None).cast("smallint"))), landing)
    ingest_arrivals_as_deltas(spark, landing, root, progress)
    whole = str(tmp_path / "whole")
    ingest_days(spark, landing, whole, DAYS[:1])
    assert same_answer(read_layout(spark, root, "sorted"), read_layout(spark, whole, "sorted"))


def test_added_events_may_come_again_and_bad_ones_are_refused(spark, events, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    day = events.where(F.col("day") == F.lit(DAYS[0]))
    none = add_arrivals(spark, day.limit(0), landing, root)
    assert none.count() == 0 and hf.present_days(spark, f"{root}/sorted") == []
    add_arrivals(spark, day.where("event_id % 2 = 0"), landing, root)
    add_arrivals(spark, day, landing, root)
    add_arrivals(spark, day, landing, root)
    assert same_answer(read_layout(spark, root, "sorted").drop("conn"), day)
    for column in ("event_id", "day"):
        bad = day.limit(3).withColumn(column, F.lit(None).cast(day.schema[column].dataType))
        with pytest.raises(BadDay):
            add_arrivals(spark, bad, landing, root)
    assert same_answer(read_layout(spark, root, "sorted").drop("conn"), day)
    compact_days(spark, root, DAYS[:1])
    assert same_answer(read_layout(spark, root, "sorted").drop("conn"), day)


def test_adding_that_is_cut_off_is_undone(spark, events, tmp_path, monkeypatch):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "root")
    days = events.where(F.col("day").isin(DAYS[:2]))
    add_arrivals(spark, days.where("event_id % 2 = 0"), landing, root)
    before = {r["path"] for r in list_files(spark, f"{root}/sorted").collect()}
    drop, real = hf.drop, hf.exists

    def cut_off(*args, **kwargs):
        raise KeyboardInterrupt

    # the files are moved in, but the run ends before it can say so
    monkeypatch.setattr(hf, "drop", lambda s, p: cut_off() if p.endswith("_journal") else drop(s, p))
    with pytest.raises(KeyboardInterrupt):
        add_arrivals(spark, days, landing, root)
    monkeypatch.setattr(hf, "drop", drop)
    journal = f"{root}/sorted_journal"
    assert real(spark, f"{journal}/done")
    hf.drop(spark, f"{journal}/done")
    monkeypatch.setattr(hf, "LEASE_SECONDS", 0)
    hf.recover(spark, hf._in_days(f"{root}/sorted"), journal)
    assert {r["path"] for r in list_files(spark, f"{root}/sorted").collect()} == before
    add_arrivals(spark, days, landing, root)
    assert same_answer(read_layout(spark, root, "sorted").drop("conn"), days)
