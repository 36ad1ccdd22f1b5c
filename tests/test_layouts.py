from __future__ import annotations

from contextlib import contextmanager
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.fixed_values import TINY_FILES_PER_DAY
from eventlake.operators.compare import fingerprint, same_answer
from eventlake.operators.layout_report import layout_files, layout_sizes
from eventlake.operators.row_order import count_flips
from eventlake.plans import layouts as lay
from eventlake.plans import questions as ask
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import LAYOUTS, device_events, error_codes, read_layout
from eventlake.sources.files import files_read, list_files
from eventlake.sources.views import read_small_table, register_views

DAYS = [date(2024, 1, d) for d in (1, 2, 3, 4)]


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return device_events(spark, sf_dir, DAYS[0], DAYS[-1])


@pytest.fixture(scope="module")
def root(spark, events, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layouts"))
    lay.write_by_day(events, f"{root}/by_day")
    lay.build_layouts(spark, root)
    return root


def modified(spark, root, layout):
    rows = list_files(spark, f"{root}/{LAYOUTS[layout][0]}").collect()
    return {r["path"]: r["modificationTime"] for r in rows}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_each_layout_holds_the_same_rows(spark, events, root, layout):
    columns = [c for c in events.columns]
    assert same_answer(read_layout(spark, root, layout).select(columns), events)
    prints = [fingerprint(df, ["event_id", "duration_ms"], ["error_code"]).first()
              for df in (events, read_layout(spark, root, layout))]
    assert prints[0] == prints[1]


def test_sorted_files_change_status_once(spark, root):
    flips = count_flips(read_layout(spark, root, "sorted"), "status").collect()
    assert len(flips) == len(DAYS) and {r["flips"] for r in flips} == {1}


def test_flips_are_counted_across_runs(spark, root):
    cleaned = read_layout(spark, root, "by_day")
    whole = {r["file"]: r["flips"] for r in count_flips(cleaned, "status").collect()}
    cut = {r["file"]: r["flips"] for r in count_flips(cleaned, "status", rows_per_run=3).collect()}
    assert whole == cut and max(whole.values()) > 1


def test_file_counts(spark, events, root):
    def files(layout):
        return list_files(spark, f"{root}/{layout}", "*.parquet").count()

    chunks = events.select("day", F.col("event_id") % TINY_FILES_PER_DAY).distinct().count()
    assert files("by_day") == files("sorted") == len(DAYS)
    assert files("tiny_files") == chunks
    assert files("single") == 1


def test_sizes(spark, events, root):
    rows = events.count()
    sizes = {r["layout"]: r for r in layout_sizes(layout_files(spark, root), rows).collect()}
    assert set(sizes) == {*LAYOUTS, "rollup_daily_health", "rollup_daily_errors"}
    assert sizes["single"]["bytes_per_row"] < sizes["csv"]["bytes_per_row"]


def test_second_build_leaves_finished_layouts_alone(spark, root):
    before = {n: modified(spark, root, n) for n in LAYOUTS}
    lay.build_layouts(spark, root)
    assert {n: modified(spark, root, n) for n in LAYOUTS} == before


def test_build_adds_days_that_came_later(spark, sf_dir, root, tmp_path):
    target = str(tmp_path)
    lay.write_by_day(device_events(spark, sf_dir, DAYS[0], DAYS[1]), f"{target}/by_day")
    lay.build_layouts(spark, target)
    before = modified(spark, target, "sorted")
    lay.write_by_day(device_events(spark, sf_dir, DAYS[2], DAYS[2]), f"{target}/by_day", replace_days=True)
    lay.build_layouts(spark, target)
    after = modified(spark, target, "sorted")
    assert hf.present_days(spark, f"{target}/sorted") == DAYS[:3]
    assert before.items() <= after.items()
    health = read_small_table(spark, target, "rollup_daily_health")
    assert health.select("day").distinct().count() == 3


def test_only_named_layouts_are_built(spark, events, tmp_path):
    root = str(tmp_path)
    lay.write_by_day(events, f"{root}/by_day")
    lay.build_layouts(spark, root, layouts=("sorted", "single"))
    assert all(hf.exists(spark, f"{root}/{n}") for n in ("sorted", "single"))
    assert not any(hf.exists(spark, f"{root}/{n}") for n in ("csv", "tiny_files"))
    with pytest.raises(ValueError, match="no layout"):
        lay.build_layouts(spark, root, layouts=("heap",))


def test_every_layout_follows_new_changed_and_dropped_days(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    events = device_events(spark, sf_dir, DAYS[0], DAYS[2])
    lay.write_by_day(events.where(F.col("day") < F.lit(DAYS[2])), f"{root}/by_day")
    lay.build_layouts(spark, root)
    lay.write_by_day(events.where(F.col("day") == F.lit(DAYS[2])), f"{root}/by_day", replace_days=True)
    lay.write_by_day(events.where((F.col("day") == F.lit(DAYS[1])) & (F.col("event_id") % 2 == 0)), f"{root}/by_day", replace_days=True)
    hf.drop(spark, f"{root}/by_day/day={DAYS[0]}")
    assert {"sorted", "tiny_files", "single", "csv", "rollup_daily_health"} <= set(lay.build_layouts(spark, root))
    now = read_layout(spark, root, "by_day")
    assert {r["day"] for r in now.select("day").distinct().collect()} == set(DAYS[1:3])
    for name in LAYOUTS:
        assert same_answer(read_layout(spark, root, name).select(events.columns), now)
    health = read_small_table(spark, root, "rollup_daily_health")
    assert {r["day"]: r["n"] for r in health.groupBy("day").agg(F.sum("events").alias("n")).collect()} == {
        r["day"]: r["n"] for r in now.groupBy("day").agg(F.count("*").alias("n")).collect()}
    assert lay.build_layouts(spark, root) == []


def test_rollups_are_few_files(spark, events, root):
    files = list_files(spark, f"{root}/rollups/rollup_daily_health", "*.parquet").count()
    assert files == 1 < len(DAYS)


@pytest.mark.parametrize("stop", ["aside", "half"])
def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch, stop):
    """A run that ends between its renames is undone by the next one."""
    root = str(tmp_path)
    def table(path, value):
        spark.range(1).select(F.lit(value).alias("v")).write.parquet(path)
    for n in ("a", "b"):
        table(f"{root}/{n}", "old")
    moves = {n: (f"{root}/new/{n}", f"{root}/{n}") for n in ("a", "b", "c")}
    for n in moves:
        table(f"{root}/new/{n}", "new")
    journal = f"{root}/journal"
    # the folders as a run leaves them that is cut off
    import os
    os.makedirs(f"{journal}/old")
    os.makedirs(f"{journal}/absent/c")
    os.rename(f"{root}/a", f"{journal}/old/a")
    if stop == "half":
        os.rename(f"{root}/b", f"{journal}/old/b")
        os.makedirs(f"{journal}/all_aside")
        os.rename(f"{root}/new/a", f"{root}/a")
        os.rename(f"{root}/new/c", f"{root}/c")
    hf.recover(spark, lambda n: f"{root}/{n}", journal)
    assert [spark.read.parquet(f"{root}/{n}").first()["v"] for n in ("a", "b")] == ["old", "old"]
    assert not hf.exists(spark, f"{root}/c") and not hf.exists(spark, journal)


def test_two_publishes_do_not_undo_each_other(spark, tmp_path, monkeypatch):
    """A second run that comes while the first one moves is refused and changes nothing; after the first one it goes through."""
    root = str(tmp_path)
    for n, v in (("final/day=2024-01-01", "old"), ("a/day=2024-01-01", "new"), ("b/day=2024-01-02", "other")):
        spark.range(1).select(F.lit(v).alias("v")).write.parquet(f"{root}/{n}")
    refused = []

    def second():
        with pytest.raises(hf.Held, match="is publishing"):
            hf.replace_days(spark, f"{root}/b", f"{root}/final", [DAYS[1]])
        refused.append(hf.exists(spark, f"{root}/b/day=2024-01-02"))

    exists = hf.exists
    monkeypatch.setattr(hf, "_say", lambda *a, say=hf._say, **kw: (say(*a, **kw), second())[0] if not refused else say(*a, **kw))
    hf.replace_days(spark, f"{root}/a", f"{root}/final", [DAYS[0]])
    monkeypatch.undo()
    assert refused == [True] and hf.present_days(spark, f"{root}/final") == [DAYS[0]]
    assert spark.read.parquet(f"{root}/final/day=2024-01-01").first()["v"] == "new"
    hf.replace_days(spark, f"{root}/b", f"{root}/final", [DAYS[1]])
    assert hf.present_days(spark, f"{root}/final") == DAYS[:2] and not exists(spark, f"{root}/final_journal")


def test_a_run_that_died_is_undone_after_its_lease(spark, tmp_path, monkeypatch):
    import os
    root, journal = str(tmp_path), str(tmp_path / "final_journal")
    spark.range(1).select(F.lit("new").alias("v")).write.parquet(f"{root}/b/day=2024-01-01")
    os.makedirs(f"{journal}/old/day=2024-01-01")
    (tmp_path / "final_journal" / "old" / "day=2024-01-01" / "x").write_text("old")
    hf._say(spark, journal, "dead", first=True)
    with pytest.raises(hf.Held):
        hf._say(spark, journal, "late", first=True)
    with pytest.raises(hf.Held):
        hf.replace_days(spark, f"{root}/b", f"{root}/final", [DAYS[0]])
    monkeypatch.setattr(hf, "LEASE_SECONDS", 0)
    hf.recover(spark, lambda n: f"{root}/final/{n}", journal)
    assert os.listdir(f"{root}/final/day=2024-01-01") == ["x"] or sorted(os.listdir(f"{root}/final/day=2024-01-01"))[-1] == "x"
    hf.replace_days(spark, f"{root}/b", f"{root}/final", [DAYS[0]])
    assert spark.read.parquet(f"{root}/final/day=2024-01-01").first()["v"] == "new"


def test_replacing_one_day_leaves_the_others(spark, events, tmp_path):
    path = str(tmp_path / "by_day")
    lay.write_by_day(events, path)
    before = {r["path"] for r in list_files(spark, path).collect()}
    lay.write_by_day(events.where(F.col("day") == F.lit(DAYS[1])), path, replace_days=True)
    after = {r["path"] for r in list_files(spark, path).collect()}
    assert {p.split("day=")[1][:10] for p in before ^ after} == {str(DAYS[1])}
    assert spark.read.parquet(path).count() == events.count()


def test_views(spark, events, root):
    names = register_views(spark, root)
    assert {f"events_{n}" for n in LAYOUTS} | {"events", "error_codes"} <= set(names)
    assert spark.table("events_sorted").count() == events.count()
    assert "runs" not in names


def test_error_1042_has_its_meaning(spark):
    assert error_codes(spark).where("code = 1042").first()["meaning"] == "update download failed"


def test_rollups_answer_as_the_raw_events(spark, events, root):
    health = read_small_table(spark, root, "rollup_daily_health")
    errors = read_small_table(spark, root, "rollup_daily_errors")
    codes = read_small_table(spark, root, "error_codes")
    w = (DAYS[0], DAYS[-1])
    pairs = [
        (ask.failures_one_day(events, DAYS[2]), ask.failures_one_day_rollup(health, DAYS[2])),
        (ask.failures_one_day(events, date(2020, 1, 1)), ask.failures_one_day_rollup(health, date(2020, 1, 1))),
        (ask.top_errors(events, codes, *w), ask.top_errors_rollup(errors, codes, *w)),
        (ask.fail_rate_by_model_os(events), ask.fail_rate_by_model_os_rollup(health)),
        (ask.failures_per_day(events, *w), ask.failures_per_day_rollup(health, *w)),
    ]
    for raw, small in pairs:
        assert [tuple(map(str, r)) for r in raw.collect()] == [tuple(map(str, r)) for r in small.collect()]


def test_json_and_column_answers_agree(spark, root):
    cleaned = read_layout(spark, root, "sorted")
    w = (DAYS[0], DAYS[-1])
    assert same_answer(ask.failures_by_conn_json(cleaned, *w), ask.failures_by_conn_column(cleaned, *w))


def test_one_day_question_prunes_to_one_day(spark, root):
    day = read_layout(spark, root, "sorted").where(F.col("day") == F.lit(DAYS[1]))
    assert files_read(day).count() == 1
    plan = day.where("status = 'fail'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(status,fail)" in plan
    assert "payload" not in plan.split("ReadSchema")[1]


def test_a_day_with_most_rows_is_split_over_tasks(spark, sf_dir, tmp_path):
    # two thirds of all rows on one day; files are kept small, so that the split shows
    events = device_events(spark, "/root/testdata/sf0.1").repartition(16)
    hot = events.withColumn("day", F.when(F.col("event_id") % 3 > 0, F.lit(DAYS[0])).otherwise(F.col("day")))
    # ranges first, then small neighbours are put together
    with settings(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64"}):
        lay.write_sorted(lay.with_conn(hot), str(tmp_path / "sorted"))
    stored = read_layout(spark, str(tmp_path), "sorted")
    per_file = stored.where(F.col("day") == F.lit(DAYS[0])).groupBy(F.col("_metadata.file_path")).count()
    sizes = [r["count"] for r in per_file.collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 3
    assert stored.count() == events.count()
    flips = count_flips(stored, "status").agg(F.max("flips")).first()[0]
    assert flips == 1


@contextmanager
def settings(spark, **conf):
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_failures_of_a_large_day_lie_in_few_files(spark, tmp_path):
    events = device_events(spark, "/root/testdata/sf0.1").withColumn("day", F.lit(DAYS[0])).repartition(16)
    with settings(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64"}):
        lay.write_sorted(lay.with_conn(events), str(tmp_path / "sorted"))
    stored = read_layout(spark, str(tmp_path), "sorted")
    per_file = stored.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "fail").alias("bad")).orderBy("file").collect()
    bad = [r["bad"] for r in per_file]
    share = sum(bad) / sum(r["rows"] for r in per_file)
    assert len(per_file) >= 5 and sum(b > 0 for b in bad) <= share * len(per_file) + 2
    assert bad == sorted(bad, reverse=True) or bad[0] == per_file[0]["rows"]  # they come first
    # nulls come last within the codes, and a code lies in neighbouring files
    spans = stored.where("status = 'fail'").groupBy("error_code").agg(F.countDistinct("_metadata.file_path").alias("files")).agg(F.max("files")).first()[0]
    assert spans <= 2


def test_a_value_that_all_rows_share_is_still_split(spark, tmp_path):
    events = device_events(spark, "/root/testdata/sf0.1")
    same = events.withColumns({"day": F.lit(DAYS[0]), "status": F.lit("fail"), "error_code": F.lit(1000).cast("smallint"), "device_model": F.lit("m"),
                               "event_ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")}).repartition(16)
    with settings(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64"}):
        lay.write_sorted(lay.with_conn(same), str(tmp_path / "sorted"))
    sizes = [r["count"] for r in read_layout(spark, str(tmp_path), "sorted").groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2 and sum(sizes) == 100_000


def rows_scanned(df):
    """Rows that the scan of a query gave out: those of the row groups that were read."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))
    return total


def test_bloom_filters_skip_row_groups_of_other_devices(spark, tmp_path):
    """Row groups whose range holds the device, and whose ids are too many for a dictionary: only the filter can tell."""
    n = 40_000
    device = F.when(F.col("id") % 7 == 0, F.lit(n * 2)).when(F.col("id") % 7 == 1, F.lit(-1)).otherwise(F.col("id") * 2)
    frame = spark.range(n).repartition(4).select(device.alias("device_id"), F.lit(DAYS[0]).alias("day"), F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    path = str(tmp_path / "days")
    with settings(spark, **{"parquet.enable.dictionary": "false"}):
        lay._write_days(frame, path, row_group_bytes=1 << 18, bloom=("device_id",))
    stored = spark.read.parquet(path)
    every = rows_scanned(stored.where("device_id >= -1").select("event_id"))
    present = stored.where("device_id = 24").select("event_id")
    assert every == n and present.count() == 1
    assert 0 < rows_scanned(present) <= n / 2
    # in the range of every row group, in none of them
    assert rows_scanned(stored.where("device_id = 25").select("event_id")) <= n / 8


def test_event_number_is_taken_from_its_json_once(spark, sf_dir):
    """A parse for each use of the number made each pass over the events several times dearer."""
    plan = device_events(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1
