"""Two levels of statistics and the tree of hashes say what the whole tables say."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.operators import compare
from eventlake.operators.scan_estimate import estimate_scan
from eventlake.operators.zone_map import refresh_days, save_zone_map
from eventlake.plans import layouts as lay
from eventlake.schemas import SCAN_STATS
from eventlake.sources.events import device_events, read_layout
from eventlake.sources.files import files_read
from eventlake.sources.footers import read_row_groups

DAYS = [date(2024, 1, d) for d in range(1, 9)]
QUESTIONS = [
    (["day", "status"], {"day": (DAYS[7], DAYS[7]), "status": ("fail", "fail")}),
    (["day", "status", "error_code"], {"day": (DAYS[1], DAYS[7]), "status": ("fail", "fail")}),
    (["error_code", "device_id"], {"error_code": (1042, 1042)}),
    (["device_model", "os_version", "status"], {}),
    (["event_ts"], {"device_id": (9, 10), "event_ts": ("2024-01-03", "2024-01-03 12:00:00")}),
    (["payload"], {"nothing": (1, 2)}),
    (["nothing"], {"day": (DAYS[0], DAYS[2])}),
    (["device_id"], {"device_id": (-5, -1)}),
]


@pytest.fixture(scope="module")
def root(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("zones"))
    lay.write_by_day(device_events(spark, sf_dir, DAYS[0], DAYS[-1]), f"{root}/by_day")
    lay.build_layouts(spark, root, layouts=("sorted", "single", "tiny_files"))
    return root


@pytest.mark.parametrize("name", ["by_day", "sorted", "single", "tiny_files"])
def test_equal_bytes_and_files(spark, root, tmp_path, name):
    stats = read_row_groups(spark, f"{root}/{name}").cache()
    zones = save_zone_map(spark, stats, str(tmp_path / "zones"))
    for asked in QUESTIONS:
        assert tuple(zones.estimate(*asked).first()) == tuple(estimate_scan(stats, *asked).first()), asked
    stats.unpersist()


def test_made_bounds(spark, tmp_path):
    rng = random.Random(6)
    bounds = [None, "1", "5", "10", "9.5", "-3", "a", "b", "2024-01-02", ""]
    rows = []
    for f in range(40):
        folder = rng.choice(["t/", "t/day=2024-01-01/", "t/day=2024-01-05/", "t/day=oops/"])
        stored = rng.random() < 0.3
        for g in range(rng.randint(1, 3)):
            for column in ["x", "y", *(["day"] if stored else [])]:
                lo, hi = rng.choice(bounds), rng.choice(bounds)
                rows.append((f"{folder}f{f}", g, column, lo, hi, rng.randint(1, 9), rng.random() < 0.2))
    stats = spark.createDataFrame(rows, SCAN_STATS).cache()
    zones = save_zone_map(spark, stats, str(tmp_path / "zones"))
    for filters in ({}, {"x": (1, 5)}, {"x": (20, 30)}, {"x": ("a", "a")}, {"y": ("zz", "zz")}, {"x": (-9, -8), "y": (0, 3)}, {"day": (DAYS[0], DAYS[0])},
                    {"day": (DAYS[4], DAYS[5]), "x": (11, 12)}, {"day": ("2024-01-05", "2024-01-05")}, {"z": (1, 1)}):
        for columns in (["x"], ["x", "y", "day"], ["z"]):
            assert tuple(zones.estimate(columns, filters).first()) == tuple(estimate_scan(stats, columns, filters).first()), (columns, filters)
    stats.unpersist()


def test_one_day_opens_one_folder_of_statistics(spark, root, tmp_path):
    zones = save_zone_map(spark, read_row_groups(spark, f"{root}/by_day"), str(tmp_path / "zones"))
    filters = {"day": (DAYS[3], DAYS[3]), "status": ("fail", "fail")}
    for table, schema in (("files", "FILES"), ("row_groups", "ROW_GROUPS")):
        import eventlake.operators.zone_map as z
        opened = files_read(zones._open(table, getattr(z, schema), filters)).collect()
        assert len(opened) == 1 and f"day={DAYS[3]}" in opened[0]["file"]
    plan = zones.estimate(["status"], filters)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [(isnull(day") == 2


def test_refresh_of_days(spark, sf_dir, root, tmp_path):
    target = str(tmp_path / "layout")
    lay.write_by_day(device_events(spark, sf_dir, DAYS[0], DAYS[3]), f"{target}/by_day")
    zones = save_zone_map(spark, read_row_groups(spark, f"{target}/by_day"), f"{target}/zones")
    fewer = device_events(spark, sf_dir, DAYS[1], DAYS[1]).where("event_id % 2 = 0")
    lay.write_by_day(fewer, f"{target}/by_day", replace_days=True)
    stats = read_row_groups(spark, f"{target}/by_day")
    refresh_days(zones, stats, [DAYS[1], DAYS[6]])
    for asked in QUESTIONS:
        assert tuple(zones.estimate(*asked).first()) == tuple(estimate_scan(stats, *asked).first()), asked


# ---- tree of hashes

def test_tree_of_hashes_finds_the_same_rows(spark, sf_dir, root):
    events = read_layout(spark, root, "by_day").drop("payload")
    fewer = events.where("event_id % 97 <> 3").unionByName(events.where("event_id % 89 = 2"))
    nulled = events.withColumn("day", F.when(F.col("event_id") % 50 > 0, F.col("day")))
    for a, b in ((events, fewer), (fewer, events), (nulled, events), (events, events), (events, events.limit(0))):
        want = sorted(map(repr, compare.differences(a, b).select(*a.columns, "surplus").collect()))
        for held in (200_000, 3):  # also with more unequal buckets than are held
            got = compare.tree_differences(a, b, "day", held_buckets=held)
            assert sorted(map(repr, got.select(*a.columns, "surplus").collect())) == want
    with pytest.raises(ValueError, match="different columns"):
        compare.tree_differences(events, events.drop("status"), "day")


def test_nearly_equal_tables_move_few_rows(spark, root):
    events = read_layout(spark, root, "by_day").select("event_id", "day", "status")
    other = events.withColumn("status", F.when(F.col("event_id") == 17, "odd").otherwise(F.col("status")))
    assert compare.tree_differences(events, other, "day").count() == 2
    both = compare._hashes(events, events.columns, "day", 1).unionByName(compare._hashes(other, events.columns, "day", -1))
    days = compare._unequal(both, "_day").collect()
    buckets = compare._unequal(both, "_day", "_bucket")
    moved = both.join(buckets, ["_day", "_bucket"], "left_semi").count()
    assert len(days) == 1 and moved <= max(6, 0.01 * both.count())
