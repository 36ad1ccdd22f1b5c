from __future__ import annotations

import csv
import gzip
import io
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from eventlake.plans.report_batches import ingest_batch, read_hot, read_raw
from eventlake.schemas import EXAMPLE_REPORT
from eventlake.sources import hadoop_files as hf
from eventlake.sources.report_files import BadBatch, batch_name

FULL = {
    "info": {"Model": "KR-20", "OS Version": "win11", "Restart Reason": 'a "b", c\nd', "Drain": 1.5,
             "Uptime": "1 week, 2 days, 3 hours, 7 minutes", "Other": {"x": 1}},
    "errors": {"Kernel": 3, "System": "4"},
    "networks": [{"state": "up"}, {"state": "down"}],
    "usb": [{"id": 1}, 2, "three"],
    "time_sync": {"Events": []},
}


def row(id="r1", updated="2026-06-10 10:00:00+00:00", summary=FULL, **more):
    base = {"id": id, "created_at": "2026-06-10 09:00:00+00:00", "updated_at": updated, "device_id": "d1",
            "archive_path": "a", "device_time": "2026-06-10 10:00:00+00:00", "device_kind": "k",
            "summary": json.dumps(summary) if isinstance(summary, dict) else summary, "in_use": "true"}
    return base | more


def write(path, rows, zipped=False, drop=()):
    columns = [c for c in dict.fromkeys(k for r in rows for k in r) if c not in drop]
    text = io.StringIO()
    writer = csv.DictWriter(text, columns, extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    data = text.getvalue().encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


def load(spark, tmp_path, rows, name="batch.csv", **kw):
    root = str(tmp_path / "tables")
    return ingest_batch(spark, write(tmp_path / name, rows, **kw), root), root


def hot_rows(spark, root):
    return {r["id"]: r for r in read_hot(spark, root).collect()}


def test_columns_are_pulled_out_of_the_json(spark, tmp_path):
    record, root = load(spark, tmp_path, [row()])
    hot = hot_rows(spark, root)["r1"]
    assert hot["model"] == "KR-20" and hot["os_version"] == "win11"
    assert hot["restart_reason"] == 'a "b", c\nd'
    assert hot["battery_drain"] == 1.5 and (hot["err_kernel"], hot["err_system"]) == (3, 4)
    assert hot["net_state"] == "up" and hot["uptime_min"] == 13147
    assert (hot["n_usb"], hot["n_time_events"]) == (3, 0)
    assert hot["clock_bad"] is False and hot["day"] == date(2026, 6, 10) and hot["batch"] == "batch"
    assert (record["rows"], record["repeats"], record["days"]) == (1, 0, 1)
    assert read_raw(spark, root).first()["summary"] == json.dumps(FULL)


def test_newest_row_per_id_wins(spark, tmp_path):
    rows = [row(updated=f"2026-06-1{i} 10:00:00+00:00", device_kind=f"v{i}") for i in (1, 3, 2)]
    record, root = load(spark, tmp_path, [*rows, row("r2")])
    assert (record["rows"], record["repeats"], record["hot_rows"]) == (4, 2, 2)
    assert hot_rows(spark, root)["r1"]["device_kind"] == "v3"
    assert read_raw(spark, root).count() == 4


def test_missing_json_and_odd_leaves(spark, tmp_path):
    odd = {"info": "text", "errors": {"Kernel": "12.7", "System": "x"}, "networks": [], "usb": "none"}
    record, root = load(spark, tmp_path, [row("a", summary=""), row("b", summary=odd)])
    hot = hot_rows(spark, root)
    assert record["rows_without_json"] == 1
    assert hot["a"]["model"] is None and (hot["a"]["n_usb"], hot["a"]["n_time_events"]) == (0, 0)
    assert hot["b"]["model"] is None and hot["b"]["net_state"] is None
    assert (hot["b"]["err_kernel"], hot["b"]["err_system"], hot["b"]["n_usb"]) == (13, None, 0)


def test_device_clock(spark, tmp_path):
    times = {"ahead": "2026-06-11 10:00:01+00:00", "edge": "2026-06-11 10:00:00+00:00",
             "behind": "2026-05-11 09:59:59+00:00", "none": ""}
    _, root = load(spark, tmp_path, [row(k, device_time=t) for k, t in times.items()])
    assert {k: r["clock_bad"] for k, r in hot_rows(spark, root).items()} == {
        "ahead": True, "edge": False, "behind": True, "none": None}


def test_day_is_the_utc_day_of_the_server_clock(spark, tmp_path):
    _, root = load(spark, tmp_path, [row(updated="2026-06-10 23:30:00-02:00")])
    hot = hot_rows(spark, root)["r1"]
    assert hot["day"] == date(2026, 6, 11)
    stamp = read_hot(spark, root).select(F.to_utc_timestamp("received_at", F.current_timezone())
                                         .cast("timestamp_ntz")).first()[0]
    assert stamp == datetime(2026, 6, 11, 1, 30)


@pytest.mark.parametrize("name, zipped", [("plain.csv", True), ("zipped.csv.gz", False), ("other.txt", True)])
def test_compression_goes_by_content(spark, tmp_path, name, zipped):
    record, root = load(spark, tmp_path, [row(), row("r2")], name=name, zipped=zipped)
    assert record["rows"] == 2 and set(hot_rows(spark, root)) == {"r1", "r2"}


def test_extra_columns_stay_in_raw(spark, tmp_path):
    _, root = load(spark, tmp_path, [row(extra="007")])
    assert read_raw(spark, root).first()["extra"] == "007"
    assert "extra" not in read_hot(spark, root).columns


def test_a_folder_of_files_is_one_batch(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    write(folder / "a.csv", [row("r1"), row("r2")])
    write(folder / "b.csv", [row("r3")], zipped=True)
    record = ingest_batch(spark, str(folder), str(tmp_path / "tables"))
    assert record["batch"] == "big" and record["hot_rows"] == 3


def test_refused_batches_leave_nothing_behind(spark, tmp_path):
    bad = {
        "null id": [row(""), row("r2")],
        "no server clock": [row(updated="")],
        "malformed": [row(summary="{broken")],
        "trailing": [row(summary='{"a":1} x')],
        "second value": [row(summary='{"a":1}],[oops')],
    }
    reasons = {"null id": "no id", "no server clock": "no updated_at", "malformed": "malformed JSON",
               "trailing": "malformed JSON", "second value": "malformed JSON"}
    for label, rows in bad.items():
        with pytest.raises(BadBatch, match=reasons[label]):
            load(spark, tmp_path, rows)
    root = str(tmp_path / "tables")
    assert not hf.exists(spark, f"{root}/reports_hot") and hf.child_names(spark, f"{root}/_incoming") == []


def test_a_load_that_was_cut_off_is_undone(spark, tmp_path):
    """The old batch is set aside outside of what the next load drops first, even if that one is refused."""
    import os
    _, root = load(spark, tmp_path, [row("old")])
    os.makedirs(f"{root}/_replaced/batch/old")
    for table in ("reports_raw", "reports_hot"):
        os.rename(f"{root}/{table}/batch=batch", f"{root}/_replaced/batch/old/{table}")
    with pytest.raises(BadBatch):
        load(spark, tmp_path, [row("")])
    assert set(hot_rows(spark, root)) == {"old"} and read_raw(spark, root).first()["id"] == "old"
    load(spark, tmp_path, [row("new")])
    assert set(hot_rows(spark, root)) == {"new"} and read_raw(spark, root).first()["id"] == "new"


def test_nested_folders_are_refused(spark, tmp_path):
    folder = tmp_path / "nested"
    (folder / "inner").mkdir(parents=True)
    write(folder / "a.csv", [row("r1")])
    write(folder / "inner" / "b.csv", [row("r2")])
    with pytest.raises(BadBatch, match="inner"):
        ingest_batch(spark, str(folder), str(tmp_path / "tables"))


def test_files_that_cannot_be_a_batch(spark, tmp_path):
    root = str(tmp_path / "tables")
    with pytest.raises(BadBatch, match="no file"):
        ingest_batch(spark, str(tmp_path / "absent.csv"), root)
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(BadBatch, match="empty"):
        ingest_batch(spark, str(tmp_path / "empty.csv"), root)
    with pytest.raises(BadBatch, match="lacks.*in_use, summary"):
        ingest_batch(spark, write(tmp_path / "short.csv", [row()], drop=("summary", "in_use")), root)
    with pytest.raises(BadBatch, match="batch name"):
        ingest_batch(spark, write(tmp_path / "a b.csv", [row()]), root)


def test_batch_names():
    assert batch_name("/x/2026-06-10.csv.gz") == batch_name("s3://b/2026-06-10.csv") == "2026-06-10"
    assert batch_name("/x/folder/") == "folder"


def test_same_batch_again_drops_stale_days(spark, tmp_path):
    days = ["2026-06-10 10:00:00+00:00", "2026-06-11 10:00:00+00:00"]
    _, root = load(spark, tmp_path, [row("r1", days[0]), row("r2", days[1])])
    load(spark, tmp_path, [row("o1", days[0])], name="other.csv")
    load(spark, tmp_path, [row("r1", days[0])])
    assert set(hot_rows(spark, root)) == {"r1", "o1"}
    assert hf.child_names(spark, f"{root}/reports_hot/batch=batch") == ["_SUCCESS", "day=2026-06-10"]


def test_a_refused_reload_keeps_the_old_batch(spark, tmp_path):
    _, root = load(spark, tmp_path, [row("r1")])
    with pytest.raises(BadBatch):
        load(spark, tmp_path, [row("r2", summary="{broken")])
    assert set(hot_rows(spark, root)) == {"r1"}


def test_files_are_sorted_and_days_not_stored_twice(spark, tmp_path):
    rows = [row(f"r{i}", f"2026-06-1{i % 2} 10:00:0{i % 7}+00:00", device_id=f"d{i % 5}") for i in range(40)]
    _, root = load(spark, tmp_path, rows)
    import pyarrow.parquet as pq
    for folder in (tmp_path / "tables/reports_hot/batch=batch").glob("day=*"):
        for file in folder.glob("*.parquet"):
            with file.open("rb") as f:
                table = pq.read_table(f)
            keys = list(zip(table["device_id"].to_pylist(), table["received_at"].to_pylist()))
            assert keys == sorted(keys) and "day" not in table.column_names


def test_a_spec_of_ones_own(spark, tmp_path):
    from dataclasses import replace
    spec = replace(EXAMPLE_REPORT, json_fields={"second": (("networks", 1, "state"), "string"),
                                                "deep": (("info", "Other", "x"), "bigint")},
                   durations={}, list_counts={})
    root = str(tmp_path / "tables")
    ingest_batch(spark, write(tmp_path / "b.csv", [row()]), root, spec)
    hot = read_hot(spark, root, spec).first()
    assert (hot["second"], hot["deep"]) == ("down", 1) and "model" not in hot


def test_report_rows_take_the_number_from_its_json_once(spark, sf_dir):
    """A parse for each use of the number was most of what writing a batch file costs."""
    from eventlake.catalog.reports import report_rows
    plan = report_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


@pytest.mark.parametrize("name, files", [("report_batch_replaced", 2), ("report_batch_verdicts", 4)])
def test_a_batch_file_is_written_once(spark, sf_dir, monkeypatch, name, files):
    """The same rows were written again for each name that they are loaded under."""
    from eventlake.catalog import REGISTRY, reports
    written, real = [], reports._batch_file
    monkeypatch.setattr(reports, "_batch_file", lambda *a, **kw: written.append(a[2]) or real(*a, **kw))
    assert REGISTRY[name].run(spark, sf_dir).count() > 0
    assert len(written) == files
