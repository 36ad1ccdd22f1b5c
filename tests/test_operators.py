from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake.operators import compare, distinct, rollups
from eventlake.plans import questions as ask
from eventlake.sources.events import device_events

FIRST, LAST = date(2024, 1, 1), date(2024, 1, 30)


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return device_events(spark, sf_dir)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_differences_go_both_ways_with_multiplicity(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, t string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 3)], "t string, n bigint")
    got = {(r["n"], r["t"]): r["surplus"] for r in compare.differences(a, b).collect()}
    assert got == {("1", "x"): 1, ("3", None): -1}
    assert compare.same_answer(a, a.repartition(4)) and not compare.same_answer(a, b)
    with pytest.raises(ValueError, match="different columns"):
        compare.differences(a, b.drop("t"))


def test_fingerprint_sums_past_the_bigint_range(spark):
    df = spark.range(4).select((F.lit(9_000_000_000_000_000_000) + F.col("id")).alias("id"))
    assert int(compare.fingerprint(df, ["id"], [], hashed=True).first()["sum_id"]) == 36 * 10**18 + 6


def test_hashed_fingerprint_sees_swapped_values(spark):
    a = spark.createDataFrame([(1, 2), (2, 1)], "x int, y int")
    b = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    plain = [compare.fingerprint(df, ["x", "y"], []).first() for df in (a, b)]
    hashed = [compare.fingerprint(df, ["x", "y"], [], hashed=True).first() for df in (a, b)]
    assert plain[0] == plain[1] and hashed[0] != hashed[1]


def test_overcount_and_sketches(spark, events):
    study = distinct.overcount(events, FIRST, LAST).first()
    assert study["added_up"] > study["true_devices"]
    daily = rollups.rollup_device_sketches(events)
    merged = rollups.merge_device_sketches(daily).first()["devices"]
    assert merged == pytest.approx(study["true_devices"], rel=0.02)


def test_overcount_of_an_empty_window(events):
    row = distinct.overcount(events, date(2020, 1, 1), date(2020, 1, 2)).first()
    assert tuple(row) == (0, 0, None)


def test_exact_and_approx(events):
    windows = {"all": None, "day": (LAST, LAST), "none": (date(2020, 1, 1), date(2020, 1, 1))}
    rows = {r["window"]: r for r in distinct.exact_and_approx(events, windows).collect()}
    assert rows["all"]["exact"] == events.select("device_id").distinct().count()
    assert rows["day"]["exact"] == ask_day(events)
    assert rows["all"]["error_pct"] < 25 and rows["none"]["error_pct"] is None


def ask_day(events):
    return events.where(F.col("day") == F.lit(LAST)).select("device_id").distinct().count()


def test_failures_are_counted_before_the_lookup_join(spark, events):
    from eventlake.sources.events import error_codes
    text = plan(ask.top_errors(events, error_codes(spark), FIRST, LAST))
    assert text.index("Join") < text.index("partial_count")
    assert "Python" not in text


def test_questions_read_only_their_columns(spark, sf_dir):
    text = plan(ask.failures_one_day(device_events(spark, sf_dir, LAST, LAST), LAST))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_history_is_a_top_k_without_a_full_sort(spark, sf_dir):
    text = plan(ask.device_history(device_events(spark, sf_dir), 5, FIRST, LAST))
    assert "TakeOrderedAndProject" in text and "Exchange range" not in text


def test_profile(events):
    tables = ask.profile_events(events, "DX-300", "ios17", LAST)
    assert set(tables) == {"overview", "daily_range", "top_codes", "top_models", "incident"}
    assert tables["overview"].first()["rows"] == events.count()


def test_a_profile_sends_no_event_twice(spark, events):
    counts = ask.profile_counts(events)
    plan = ask.profile_overview(counts, events)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    empty = ask.profile_overview(counts.limit(0), events.limit(0)).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, None)]
