from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest

from eventlake.fixed_values import MAX_ROWS
from eventlake.plans import layouts as lay
from eventlake.plans.governed import (
    Aggregate,
    Filter,
    GovernedReader,
    JsonField,
    Refused,
    Request,
    Source,
    audit,
    check,
    result_kb,
)
from eventlake.sources.events import device_events, read_layout
from eventlake.sources.footers import read_row_groups
from eventlake.sources.views import SMALL_TABLES, read_small_table

FIRST, LAST = date(2024, 1, 1), date(2024, 1, 7)
COUNT = Aggregate("count", None, "n")
WEEK = Source("events", FIRST, LAST)
FAILED = Filter("status", "=", "fail")


@pytest.fixture(scope="module")
def reader(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("governed"))
    lay.write_by_day(device_events(spark, sf_dir, FIRST, date(2024, 1, 8)), f"{root}/by_day")
    lay.build_layouts(spark, root)
    tables = {n: read_small_table(spark, root, n) for n in SMALL_TABLES}
    tables["events"] = read_layout(spark, root, "sorted")
    return GovernedReader(spark, tables, read_row_groups(spark, f"{root}/sorted").cache())


REFUSED = [
    (Request(Source("secrets"), {"n": "n"}), "no approved table"),
    (Request(Source("main.events", FIRST, LAST), {}, [COUNT]), "no approved table"),
    (Request(Source("parquet.`/data/other`"), {"x": "x"}), "no approved table"),
    (Request(WEEK, {}, [COUNT], Source("users"), [("device_id", "id")]), "no approved table"),
    (Request(WEEK, every_column=True), "whole rows"),
    (Request(WEEK), "whole rows"),
    (Request(Source("events"), {}, [COUNT]), "first and a last day"),
    (Request(Source("events", filters=[FAILED]), {}, [COUNT]), "first and a last day"),
    (Request(Source("events", first=FIRST), {}, [COUNT]), "first and a last day"),
    (Request(Source("events", last=LAST), {}, [COUNT]), "first and a last day"),
    (Request(Source("events", FIRST, date(2024, 2, 1)), {}, [COUNT]), "more than 31 days"),
    (Request(Source("events", "2024-01-01", "current_date"), {}, [COUNT]), "plain dates"),
    (Request(Source("events", datetime(2024, 1, 1), LAST), {}, [COUNT]), "plain dates"),
    (Request(WEEK, {}, [COUNT], Source("events"), [("device_id", "device_id")]), "first and a last day"),
    (Request(Source("rollup_daily_health", FIRST, LAST), {}, [COUNT], Source("events"), [("day", "day")]),
     "first and a last day"),
    (Request(WEEK, {}, [Aggregate("collect_list", "payload", "p")]), "not offered"),
    (Request(WEEK, {}, [Aggregate("listagg", "payload", "p")]), "not offered"),
    (Request(WEEK, {}, [Aggregate("getenv", "payload", "p")]), "not offered"),
    (Request(Source("events", FIRST, LAST, [Filter("status", "or", "fail")]), {}, [COUNT]), "comparison"),
    (Request(Source("events", FIRST, LAST, [Filter("status", "=", object())]), {}, [COUNT]), "plain values"),
    (Request(Source("events", FIRST, LAST, [Filter("status", "in", ["ok", [1]])]), {}, [COUNT]), "plain values"),
    (Request(WEEK, {}, [COUNT], order_by=[("payload", True)]), "order by columns"),
]

ACCEPTED = [
    Request(Source("events", FIRST, LAST, [FAILED]), {}, [COUNT]),
    Request(Source("events", FIRST, date(2024, 1, 31)), {}, [COUNT]),
    Request(Source("rollup_daily_health"), {"day": "day"}, [Aggregate("sum", "events", "n")]),
    Request(Source("error_codes"), every_column=True),
    Request(WEEK, {"conn": JsonField("payload", "conn")},
            [Aggregate("approx_count_distinct", "device_id", "devices")]),
    Request(Source("events", FIRST, FIRST), {}, [COUNT], Source("events", LAST, LAST),
            [("device_id", "device_id")]),
]


@pytest.mark.parametrize("request_, reason", REFUSED)
def test_refused_with_a_reason(request_, reason):
    with pytest.raises(Refused, match=reason):
        check(request_)


@pytest.mark.parametrize("request_", ACCEPTED)
def test_accepted(reader, request_):
    check(request_)
    answer = reader.run(request_)
    assert answer.status == "ok", answer.note
    assert answer.rows


@pytest.mark.parametrize("limit, used", [(None, MAX_ROWS), (999_999, MAX_ROWS), ("5", MAX_ROWS), (-1, MAX_ROWS),
                                         (True, MAX_ROWS), (5, 5)])
def test_limit_is_set_or_pulled_down(limit, used):
    got, own = check(Request(Source("error_codes"), {"code": "code"}, limit=limit))
    assert got == used and own == (limit == 5)


def test_rollup_and_events_agree(reader):
    raw = reader.run(Request(Source("events", FIRST, LAST, [FAILED]), {}, [COUNT]))
    small = reader.run(Request(Source("rollup_daily_health", FIRST, LAST, [FAILED]), {},
                               [Aggregate("sum", "events", "n")]))
    assert raw.rows == small.rows and raw.rows[0]["n"] > 0
    assert raw.mb_scanned > 0 and small.mb_scanned == 0


def test_estimate_counts_only_what_is_mentioned(reader):
    narrow = Request(Source("events", FIRST, FIRST), {}, [COUNT])
    wide = replace(narrow, columns={"payload": "payload"})
    week = replace(narrow, source=WEEK)
    mb = [reader.scan_mb(r) for r in (narrow, wide, week)]
    assert mb[0] < mb[1] and mb[0] <= mb[2]


def test_over_budget_is_refused_before_it_runs(reader):
    tight = GovernedReader(reader.spark, reader.tables, reader.stats, budget_mb=0.001)
    answer = tight.run(Request(WEEK, {"device_id": "device_id", "payload": "payload"}))
    assert answer.status == "refused" and "budget" in answer.note and answer.rows == []


def test_large_results_are_refused_even_with_few_rows(reader):
    tight = GovernedReader(reader.spark, reader.tables, reader.stats, max_result_kb=1)
    answer = tight.run(Request(WEEK, {"device_id": "device_id", "payload": "payload"}, limit=200))
    assert answer.status == "refused" and "cap" in answer.note


def test_unknown_columns_and_engine_errors_are_answers(reader):
    for request in (Request(Source("error_codes"), {"x": "no_such_column"}),
                    Request(Source("error_codes"), {}, [Aggregate("sum", "meaning", "s")]),
                    Request(Source("error_codes"), {"x": "*"}),
                    Request(WEEK, {"d": "l.device_id"}, [Aggregate("count", "device_id", "n")],
                            Source("events", FIRST, FIRST), [("device_id", "device_id")])):
        answer = reader.run(request)
        assert answer.status == "refused" and "could not run" in answer.note


def test_weighted_join_equals_the_joined_rows(spark, reader):
    a, b = (Source("events", d, d) for d in (FIRST, LAST))
    measures = [COUNT, Aggregate("count", "l.error_code", "codes"), Aggregate("sum", "l.duration_ms", "s"),
                Aggregate("avg", "r.duration_ms", "a"), Aggregate("min", "r.duration_ms", "lo"),
                Aggregate("max", "l.duration_ms", "hi"), Aggregate("count_distinct", "l.device_id", "d")]
    answer = reader.run(Request(a, {"status": "l.status"}, measures, b, [("device_model", "device_model")]))
    reader.tables["events"].createOrReplaceTempView("governed_events")
    plain = spark.sql(f"""
        SELECT l.status, count(*) AS n, count(l.error_code) AS codes, sum(l.duration_ms) AS s,
               avg(r.duration_ms) AS a, min(r.duration_ms) AS lo, max(l.duration_ms) AS hi,
               count(DISTINCT l.device_id) AS d
        FROM governed_events l JOIN governed_events r USING (device_model)
        WHERE l.day = DATE '{FIRST}' AND r.day = DATE '{LAST}' GROUP BY 1""")

    def rounded(rows):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)

    assert answer.status == "ok", answer.note
    assert rounded(answer.rows) == rounded(plain.collect())


def test_joined_rows_without_aggregates(reader):
    answer = reader.run(Request(Source("events", FIRST, FIRST, [FAILED]), {"e": "event_id", "m": "meaning"}, (),
                                Source("error_codes"), [("error_code", "code")]))
    assert answer.status == "ok" and {r["m"] for r in answer.rows} > {"unknown"}


def test_union_of_governed_reads(reader):
    arms = [Request(Source("events", d, d, [FAILED]), {"device_id": "device_id"}) for d in (FIRST, LAST)]
    answer = reader.run_union(*arms)
    ids = [r["device_id"] for r in answer.rows]
    assert answer.status == "ok" and len(ids) == len(set(ids)) > 0
    assert reader.run_union(arms[0], Request(Source("secrets"), {"x": "x"})).status == "refused"


def test_nothing_is_cut_unasked(reader):
    small = GovernedReader(reader.spark, reader.tables, reader.stats, max_rows=20)
    codes = Request(Source("error_codes"), {"code": "code"})
    answer = small.run(codes)
    assert answer.status == "refused" and "more than 20 rows" in answer.note
    assert len(small.run(replace(codes, limit=20)).rows) == 20
    low, high = (Request(Source("error_codes", filters=[Filter("code", op, edge)]), {"code": "code"}) for op, edge in (("<", 1015), (">=", 1185)))
    assert small.run(low).status == small.run(high).status == "ok"
    union = small.run_union(low, high)
    assert union.status == "refused" and "more than 20 rows" in union.note
    assert len(small.run_union(low, low).rows) == 15
    # many rows that are few different ones are no loss
    kinds = Request(WEEK, {"status": "status"})
    assert len(small.run_union(kinds, kinds).rows) == 2


def test_union_has_one_budget(reader):
    arm = Request(Source("events", FIRST, FIRST), {"device_id": "device_id"}, limit=5)
    mb = reader.scan_mb(arm)
    tight = GovernedReader(reader.spark, reader.tables, reader.stats, budget_mb=1.5 * mb)
    assert tight.run(arm).status == "ok"
    answer = tight.run_union(arm, arm)
    assert answer.status == "refused" and "budget" in answer.note


def test_pairs_are_counted_before_they_are_formed(reader):
    a, b = (Source("events", d, d) for d in (FIRST, LAST))
    request = Request(a, {"x": "l.event_id"}, (), b, [("device_model", "device_model")], limit=10)
    tight = GovernedReader(reader.spark, reader.tables, reader.stats, max_pairs=10)
    assert "pairs" in tight.run(request).note
    assert len(reader.run(request).rows) == 10


def test_window_is_a_parameter(reader):
    wide = GovernedReader(reader.spark, reader.tables, reader.stats, max_window_days=60)
    assert wide.run(Request(Source("events", FIRST, date(2024, 2, 20)), {}, [COUNT])).status == "ok"


def test_result_size_counts_nulls(spark):
    assert result_kb(spark.sql("SELECT CAST(NULL AS STRING) AS a")) > 0
    assert result_kb(spark.sql("SELECT 1 AS a WHERE false")) == 0


def test_audit(reader):
    rows = audit(reader, [replace(REFUSED[0][0], label="bad"), replace(ACCEPTED[0], label="good")]).collect()
    assert [(r["tried"], r["verdict"], r["row_count"]) for r in rows] == [("bad", "refused", 0), ("good", "ok", 1)]


def test_only_the_tables_that_a_request_names_are_built(spark, sf_dir, monkeypatch):
    """A question to the events waited for all roll-ups and device sets to be built."""
    from eventlake.catalog import REGISTRY
    from eventlake.catalog import governed as catalog
    asked, real = [], catalog.built
    monkeypatch.setattr(catalog, "built", lambda s, d, *parts: asked.append(parts) or real(s, d, *parts))
    assert REGISTRY["governed_failures_per_day"].run(spark, sf_dir).count() == 7
    assert asked == [("sorted",)]
