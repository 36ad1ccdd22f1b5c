from eventlake.functions.dates import DayRange, asked_days, clock_bad, in_window, parse_day, utc_clock, utc_day, window
from eventlake.functions.jsons import (
    as_bigint,
    as_double,
    is_malformed,
    json_path,
    json_schema,
    json_text,
    list_count,
)
from eventlake.functions.numbers import fail_pct, hash_uniform, pick
from eventlake.functions.text import day_from_path, duration_minutes, parse_count

__all__ = [
    "DayRange", "as_bigint", "as_double", "asked_days", "clock_bad", "day_from_path", "duration_minutes",
    "fail_pct", "hash_uniform", "in_window", "is_malformed", "json_path", "json_schema",
    "json_text", "list_count", "parse_count", "parse_day", "pick", "utc_clock",
    "utc_day", "window",
]
