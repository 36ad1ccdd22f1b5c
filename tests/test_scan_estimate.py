from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.operators.scan_estimate import estimate_scan, usd_per_1000
from eventlake.plans import layouts as lay
from eventlake.schemas import SCAN_STATS
from eventlake.sources.events import device_events
from eventlake.sources.files import list_files
from eventlake.sources.footers import read_row_groups

FIRST, LAST = date(2024, 1, 1), date(2024, 1, 8)


@pytest.fixture(scope="module")
def root(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scan"))
    events = device_events(spark, sf_dir, FIRST, LAST)
    lay.write_by_day(events, f"{root}/by_day")
    lay.build_layouts(spark, root)
    return root


@pytest.fixture(scope="module")
def stats(spark, root):
    return {n: read_row_groups(spark, f"{root}/{n}").cache() for n in ("by_day", "sorted", "tiny_files", "single")}


def run(stats, columns, filters):
    return tuple(estimate_scan(stats, columns, filters).first())


QUESTIONS = [
    (["day", "status"], {"day": (LAST, LAST), "status": ("fail", "fail")}),
    (["day", "status", "error_code"], {"day": (date(2024, 1, 2), LAST), "status": ("fail", "fail")}),
    (["error_code", "device_id"], {"error_code": (1042, 1042)}),
    (["device_model", "os_version", "status"], {}),
    (["event_ts"], {"device_id": (9, 10), "event_ts": ("2024-01-03", "2024-01-03 12:00:00")}),
    (["payload"], {"nothing": (1, 2)}),
]


def test_one_day_opens_one_file_and_a_week_seven(spark, stats):
    assert run(stats["by_day"], *QUESTIONS[0])[1] == 1
    assert run(stats["by_day"], *QUESTIONS[1])[1] == 7
    assert run(stats["tiny_files"], *QUESTIONS[0])[1] > 1


def test_all_columns_without_filters_is_the_compressed_size(stats):
    columns = [r["column"] for r in stats["sorted"].select("column").distinct().collect()]
    total = stats["sorted"].agg(F.sum("bytes")).first()[0]
    assert run(stats["sorted"], columns, {})[0] == total


def test_parquet_reads_less_than_csv(spark, root, stats):
    whole = list_files(spark, f"{root}/csv").agg(F.sum("length")).first()[0]
    assert run(stats["by_day"], *QUESTIONS[0])[0] < whole / 100


def test_hand_made_statistics(spark):
    rows = [
        ("f/day=2024-01-01/a", 0, "code", None, None, 5, True),       # all NULL: never matches
        ("f/day=2024-01-01/b", 0, "code", None, None, 7, False),      # unknown bounds: may match
        ("f/day=2024-01-01/c", 0, "code", "9", "10", 11, False),      # numbers, not text
        ("f/day=2024-01-01/d", 0, "code", "b", "d", 13, False),       # text
        ("f/day=2024-01-02/e", 0, "day", "2024-01-01", "2024-01-01", 17, False),   # stored day wins
        ("f/x", 0, "other", "1", "2", 19, False),                     # no such column: not filtered
    ]
    stats = spark.createDataFrame(rows, SCAN_STATS)
    every = ["code", "day", "other"]
    expected = [
        ({"code": (9, 9)}, 7 + 11 + 17 + 19, 4),
        ({"code": (10, 10)}, 7 + 11 + 17 + 19, 4),
        ({"code": (8, 8)}, 7 + 17 + 19, 3),
        ({"code": ("c", "c")}, 7 + 13 + 17 + 19, 4),
        ({"code": ("e", "f")}, 7 + 17 + 19, 3),
        ({"day": ("2024-01-01", "2024-01-01")}, 5 + 7 + 11 + 13 + 17 + 19, 6),
        ({"day": ("2024-01-02", "2024-01-02"), "code": (1, 5)}, 19, 1),
        ({}, 5 + 7 + 11 + 13 + 17 + 19, 6),
    ]
    for filters, size, files in expected:
        assert run(stats, every, filters) == (size, files), filters


def test_price_has_a_floor(spark):
    df = spark.createDataFrame([(0.01,), (10.0,), (400.0,)], "mb double")
    assert [round(r[0], 6) for r in df.select(usd_per_1000(F.col("mb"))).collect()] == [0.05, 0.05, 2.0]
