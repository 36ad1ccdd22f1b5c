"""Time the headline jobs and questions; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Layouts and roll-ups are built first and
their build is timed as a job of its own; each question is then run once to warm up, and the median
of the further runs is kept."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventlake.catalog import REGISTRY  # noqa: E402
from eventlake.catalog.base import BAD_DAY, DEVICE, ERROR_CODE, MONTH, WEEK, built, row_groups  # noqa: E402
from eventlake.operators.scan_estimate import estimate_scan  # noqa: E402
from eventlake.plans import questions as ask  # noqa: E402
from eventlake.plans.daily_ingest import ingest_days  # noqa: E402
from eventlake.session import build_session, new_scratch  # noqa: E402
from eventlake.sources import hadoop_files as hf  # noqa: E402
from eventlake.sources.events import LAYOUTS, error_codes, read_layout  # noqa: E402
from eventlake.sources.views import read_small_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

# whole-table operators that are not questions
OPERATORS = ["one_row_per_key", "latest_row_per_id", "rollup_daily_health", "rollup_daily_errors",
             "quality_report", "distinct_exact_vs_approx", "distinct_overcount", "differing_rows",
             "scan_estimate", "profile_overview"]


def once(action) -> float:
    begin = time.perf_counter()
    action()
    return time.perf_counter() - begin


def warm(action, runs: int = RUNS) -> float:
    once(action)
    return statistics.median(once(action) for _ in range(runs))


def questions(spark, root):
    """(name, function that makes the DataFrame) for every layout and for the roll-ups."""
    codes = error_codes(spark)
    for layout in LAYOUTS:
        ev = read_layout(spark, root, layout)
        yield f"failures_one_day/{layout}", lambda ev=ev: ask.failures_one_day(ev, BAD_DAY)
        yield f"top_errors_week/{layout}", lambda ev=ev: ask.top_errors(ev, codes, *WEEK)
        yield f"devices_hit_by_error/{layout}", lambda ev=ev: ask.devices_hit_by_error(ev, ERROR_CODE, *WEEK)
        yield f"fail_rate_by_model_os/{layout}", lambda ev=ev: ask.fail_rate_by_model_os(ev)
        yield f"one_device_history/{layout}", lambda ev=ev: ask.device_history(ev, DEVICE, *MONTH)
        yield f"failures_by_conn_json/{layout}", lambda ev=ev: ask.failures_by_conn_json(ev, *WEEK)
        if layout == "sorted":
            yield f"failures_by_conn_column/{layout}", lambda ev=ev: ask.failures_by_conn_column(ev, *WEEK)
    bitmaps = read_small_table(spark, root, "rollup_daily_device_bitmaps")
    health = read_small_table(spark, root, "rollup_daily_health")
    errors = read_small_table(spark, root, "rollup_daily_errors")
    yield "failures_one_day/rollup", lambda: ask.failures_one_day_rollup(health, BAD_DAY)
    yield "top_errors_week/rollup", lambda: ask.top_errors_rollup(errors, codes, *WEEK)
    yield "devices_hit_by_error/bitmaps", lambda: ask.devices_hit_by_error_rollup(bitmaps, ERROR_CODE, *WEEK)
    yield "fail_rate_by_model_os/rollup", lambda: ask.fail_rate_by_model_os_rollup(health)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        # few cores and little data: smaller tasks keep all cores at work
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32MB",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    for part in ("by_day", "sorted", "single", "csv", "tiny_files", "rollups", "error_codes", "landing"):
        times[f"build/{part}"] = once(lambda part=part: built(spark, SF_DIR, part))
    root = built(spark, SF_DIR)

    for name, make in questions(spark, root):
        # reading every small file of tiny_files takes long, fewer runs settle it
        runs = 2 if name.endswith(("tiny_files", "csv")) else RUNS
        times[name] = warm(lambda make=make: make().collect(), runs)

    for name in OPERATORS:
        run = REGISTRY[name].run
        times[f"operator/{name}"] = warm(
            lambda run=run: run(spark, SF_DIR).write.format("noop").mode("overwrite").save(), 2)

    landing = f"{root}/landing"
    days = hf.present_days(spark, landing)
    ingested = []
    times["daily_ingest/all_days"] = warm(
        lambda: ingested.append(ingest_days(spark, landing, new_scratch(spark, "bench"), days)), 1)
    rows_in = sum(r["rows_in"] for r in ingested[-1].collect())

    stats = row_groups(spark, SF_DIR, "sorted")
    mb = {}
    for label, columns, filters in (
            ("failures_one_day", ["day", "status"], {"day": (BAD_DAY, BAD_DAY), "status": ("fail", "fail")}),
            ("fail_rate_by_model_os", ["device_model", "os_version", "status"], {})):
        mb[label] = round(estimate_scan(stats, columns, filters).first()["bytes"] / 1e6, 4)

    headline = [n for n in times if n.endswith(("/sorted", "/rollup"))]
    print(json.dumps({
        "metric": "sum of warm medians, seven questions on the sorted layout and three on roll-ups",
        "value": round(sum(times[n] for n in headline if not n.startswith("build/")), 4),
        "unit": "sec",
        "queries": {n: round(t, 4) for n, t in times.items()},
        "ingest_rows_per_sec": round(rows_in / times["daily_ingest/all_days"]),
        "mb_to_read_sorted": mb,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
