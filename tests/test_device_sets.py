"""Daily sets of failing devices that are kept beside the roll-ups."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.operators.compare import same_answer
from eventlake.operators.rollups import merge_device_bitmaps, rollup_device_bitmaps
from eventlake.plans import layouts as lay
from eventlake.plans import questions as ask
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import device_events
from eventlake.sources.views import read_small_table

DAYS = [date(2024, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return device_events(spark, sf_dir, DAYS[0], DAYS[-1])


@pytest.fixture(scope="module")
def root(spark, events, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sets"))
    lay.write_rollups(events, root)
    return root


def tables(spark, root):
    return [read_small_table(spark, root, f"rollup_daily_device_{n}") for n in ("bitmaps", "sketches")]


@pytest.mark.parametrize("first, last", [(0, 0), (0, 7), (2, 5), (6, 7)])
def test_any_window_is_exact(spark, events, root, first, last):
    bitmaps, sketches = tables(spark, root)
    window = DAYS[first], DAYS[last]
    codes = [r["error_code"] for r in events.where("status = 'fail'").select("error_code").distinct().limit(4).collect()]
    for code in [*codes, 31999]:
        want = ask.devices_hit_by_error(events, code, *window).first()["devices"]
        assert ask.devices_hit_by_error_rollup(bitmaps, code, *window).first()["devices"] == want
        assert abs(ask.devices_hit_by_error_sketched(sketches, code, *window).first()["devices"] - want) <= max(1, 0.05 * want)


def test_ids_far_apart_and_missing_ones(spark):
    ids = [1, 32767, 32768, 32769, 5, 5, None, 10 ** 15, -7, -40000, -7, 0]
    rows = [(DAYS[i % 3], 1000 + i % 2, d, "fail") for i, d in enumerate(ids)] + [(DAYS[0], None, 99, "ok")]
    frame = spark.createDataFrame(rows, "day date, error_code smallint, device_id long, status string")
    got = merge_device_bitmaps(rollup_device_bitmaps(frame)).first()["devices"]
    assert got == len({d for d in ids if d is not None})
    per = {r["error_code"]: r["devices"] for r in merge_device_bitmaps(rollup_device_bitmaps(frame), "error_code").collect()}
    assert per == {1000 + k: len({d for i, d in enumerate(ids) if i % 2 == k and d is not None}) for k in (0, 1)}
    assert merge_device_bitmaps(rollup_device_bitmaps(frame.limit(0))).first()["devices"] == 0


def test_only_touched_days_change(spark, events, root, tmp_path):
    target = str(tmp_path)
    lay.write_rollups(events, target)
    changed = events.where((F.col("day") != F.lit(DAYS[1])) | (F.col("event_id") % 2 == 0))
    lay.write_rollups(changed, target, days=[DAYS[1]])
    fresh = str(tmp_path / "fresh")
    lay.write_rollups(changed, fresh)
    for name in ("rollup_daily_device_bitmaps", "rollup_daily_health", "rollup_daily_errors"):
        assert same_answer(read_small_table(spark, target, name), read_small_table(spark, fresh, name))
    assert tables(spark, target)[1].select("day", "error_code").distinct().count() == tables(spark, fresh)[1].count()
    assert not hf.exists(spark, f"{target}/rollups_journal") and hf.child_names(spark, f"{target}/_incoming") == []


def test_all_tables_or_none(spark, events, tmp_path, monkeypatch):
    """A publish that is cut off while it moves is undone in all tables."""
    root = str(tmp_path)
    lay.write_rollups(events, root)
    before = [r for n in ("rollup_daily_health", "rollup_daily_errors") for r in map(repr, read_small_table(spark, root, n).collect())]
    seen = []

    def cut_off(spark, moves, journal):
        seen.extend(moves)
        name = next(n for n in moves if n.startswith("rollup_daily_health"))
        p, fs = hf._path(spark, moves[name][1])
        fs.mkdirs(hf._path(spark, f"{journal}/old")[0])
        assert fs.rename(p, hf._path(spark, f"{journal}/old/{name}")[0])
        raise OSError("lost")

    monkeypatch.setattr(lay.hf, "publish", cut_off)
    with pytest.raises(OSError, match="lost"):
        lay.write_rollups(events.where("event_id % 2 = 0"), root)
    monkeypatch.undo()
    assert len({n.partition("--")[0] for n in seen}) == 4
    lay.write_rollups(events.limit(0), root, days=[date(2030, 1, 1)])
    assert sorted(before) == sorted(r for n in ("rollup_daily_health", "rollup_daily_errors") for r in map(repr, read_small_table(spark, root, n).collect()))
