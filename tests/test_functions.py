from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from eventlake.functions import (
    as_bigint,
    as_double,
    asked_days,
    clock_bad,
    day_from_path,
    duration_minutes,
    hash_uniform,
    is_malformed,
    parse_count,
    parse_day,
    utc_day,
    window,
)

COVERED = (date(2026, 6, 1), date(2026, 6, 3))


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_parse_day_takes_iso_days():
    assert parse_day("2025-03-24") == date(2025, 3, 24)


@pytest.mark.parametrize("text", ["24-03-2025", "2025.03.24", "2025-3-24", "20250324", "2025-04-31", "2025-00-10",
                                  "today", "", "2025-03-24 ", "2025-W13-1"])
def test_parse_day_refuses_the_rest(text):
    with pytest.raises(ValueError):
        parse_day(text)


def test_asked_days_forms():
    d = date
    assert asked_days(COVERED) is None
    assert asked_days(COVERED, on=d(2026, 6, 2)) == (d(2026, 6, 2), d(2026, 6, 2))
    assert asked_days(COVERED, first=d(2026, 6, 2)) == (d(2026, 6, 2), d(2026, 6, 3))
    assert asked_days(COVERED, last=d(2026, 6, 2)) == (d(2026, 6, 1), d(2026, 6, 2))


@pytest.mark.parametrize("args, message", [
    ({"on": date(2026, 5, 31)}, "not covered"),
    ({"on": date(2026, 6, 4)}, "not covered"),
    ({"first": date(2026, 6, 3), "last": date(2026, 6, 1)}, "before it starts"),
    ({"on": date(2026, 6, 1), "first": date(2026, 6, 1)}, "exclude each other"),
])
def test_asked_days_refuses(args, message):
    with pytest.raises(ValueError, match=message):
        asked_days(COVERED, **args)


def test_store_names_of_tasks():
    from eventlake.sources.files import arrow_uri
    assert arrow_uri("s3a://lake/a b/x") == "s3://lake/a b/x" and arrow_uri("hdfs://n:8020/x") == "hdfs://n:8020/x"
    assert arrow_uri("file:///tmp/x") == arrow_uri("file:/tmp/x") == arrow_uri("/tmp/x") == "/tmp/x"
    with pytest.raises(ValueError, match="wasb"):
        arrow_uri("wasb://c@a/x")


def test_window_is_clamped():
    assert window(date(2026, 6, 8), 7) == (date(2026, 6, 2), date(2026, 6, 8))
    assert window(date(2026, 6, 3), 7, date(2026, 6, 1)) == (date(2026, 6, 1), date(2026, 6, 3))


def test_parse_count(spark):
    texts = ["30M", "2b", "75K", "981", "1.25M", " 1_000 ", "", "many", "-3K", "0", "K", None]
    assert values(spark, texts, "t string", parse_count(F.col("t"))) == [
        30_000_000, 2_000_000_000, 75_000, 981, 1_250_000, 1000, None, None, None, None, None, None]


def test_durations(spark):
    texts = ["1 week, 2 days, 3 hours, 7 minutes", "6d 1h 9m", "none", None, "2 months", "99", "5 Hours"]
    assert values(spark, texts, "t string", duration_minutes(F.col("t"))) == [
        13147, 8709, None, None, 2, 0, 0]


def test_numbers_from_json_leaves(spark):
    texts = ["12", "1.5", "12.7", "x", "true", "false", "", None, "1e3"]
    assert values(spark, texts, "t string", as_bigint(F.col("t"))) == [12, 2, 13, None, 1, 0, None, None, 1000]
    assert values(spark, texts, "t string", as_double(F.col("t")))[:4] == [12.0, 1.5, 12.7, None]


def test_malformed_json(spark):
    texts = ['{"a":1}', "[1,2]", "12", "null", None, "{bad", "", '{"a":1} tail', "1,2", '{"a":"x\\"y,"}']
    assert values(spark, texts, "t string", is_malformed(F.col("t"))) == [
        False, False, False, False, False, True, True, True, True, False]


def test_clock_bad_at_its_bounds(spark):
    server = datetime(2026, 6, 10)
    devices = [datetime(2026, 6, 11), datetime(2026, 6, 11, 0, 0, 1), datetime(2026, 5, 11),
               datetime(2026, 5, 10, 23, 59, 59), None]
    got = values(spark, devices, "d timestamp_ntz",
                 clock_bad(F.col("d"), F.lit(str(server)).cast("timestamp_ntz")))
    assert got == [False, True, False, True, None]


def test_utc_day_does_not_follow_the_session_zone(spark):
    df = spark.sql("SELECT timestamp'2026-06-01 23:30:00Z' AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(utc_day(F.col("t"))).first()[0] == date(2026, 6, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_hash_uniform_repeats_and_spreads(spark):
    u = spark.range(20_000).select(hash_uniform("id", salt=1, seed=7).alias("u"),
                                   hash_uniform("id", salt=2, seed=7).alias("v"))
    a = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).first()
    assert 0 <= a[0] and a[1] < 1 and abs(a[2] - 0.5) < 0.02 and abs(a[3]) < 0.05
    assert u.repartition(5).agg(F.sum("u")).first()[0] == pytest.approx(u.agg(F.sum("u")).first()[0])


def test_day_from_path(spark):
    texts = ["s3://b/day=2026-06-01/p.parquet", "/x/single/p.parquet"]
    assert values(spark, texts, "p string", day_from_path(F.col("p"))) == ["2026-06-01", None]
