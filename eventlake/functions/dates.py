"""Day windows, date arguments and clock checks."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake.fixed_values import DEVICE_CLOCK_AHEAD_DAYS, DEVICE_CLOCK_BEHIND_DAYS


def parse_day(text: str) -> date:
    """The day whose ISO form is this text, and no other spelling of it."""
    try:
        day = date.fromisoformat(text)
    except ValueError:
        day = None
    if day is None or day.isoformat() != text:
        raise ValueError(f"{text!r} is no day written as YYYY-MM-DD")
    return day


class DayRange(NamedTuple):
    """A closed range of days; it is empty if it ends before it begins."""

    first: date
    last: date

    def __and__(self, other: DayRange) -> DayRange:
        return DayRange(max(self.first, other.first), min(self.last, other.last))

    def filter(self, column: str = "day") -> Column:
        """On the raw day column with literal dates, so that partitions are pruned."""
        return F.col(column).between(F.lit(self.first), F.lit(self.last))


def window(end: date, days: int, start: date = date.min) -> DayRange:
    """The last `days` days ending on `end`, not reaching before `start`."""
    return DayRange(end - timedelta(days=days - 1), end) & DayRange(start, date.max)


def asked_days(covered: tuple[date, date], on: date | None = None,
               first: date | None = None, last: date | None = None) -> DayRange | None:
    """What a caller asks of a table that covers some days: one day, or a range whose open end is the table's.

    None means that no restriction was asked for."""
    table = DayRange(*covered)
    ends = [d for d in (first, last) if d is not None]
    if on is not None and ends:
        raise ValueError("one day and a range of days exclude each other")
    if on is None and not ends:
        return None
    asked = DayRange(on, on) if on else DayRange(first or table.first, last or table.last)
    if asked.first > asked.last and all(table.first <= d <= table.last for d in ends):
        raise ValueError(f"the range ends on {asked.last}, before it starts on {asked.first}")
    if asked & table != asked:
        raise ValueError(f"{asked.first} to {asked.last} is not covered, the table holds {table.first} to {table.last}")
    return asked


def in_window(first: date, last: date, column: str = "day") -> Column:
    return DayRange(first, last).filter(column)


def utc_clock(ts: Column) -> Column:
    """UTC wall time of a zoned timestamp, whatever the session zone is."""
    # from the epoch on, because wall times in a gap of the session zone cannot be converted
    since = F.lit(timedelta(microseconds=1)) * F.unix_micros(ts)
    return F.lit("1970-01-01").cast("timestamp_ntz") + since


def utc_day(ts: Column) -> Column:
    """Calendar day in UTC of a zoned timestamp."""
    return F.to_date(utc_clock(ts))


def clock_bad(device: Column, server: Column) -> Column:
    """Device clock too far ahead of or behind the server clock; NULL where either is NULL.

    Takes wall times (see utc_clock): days of zoned timestamps can have 23 or 25 hours."""
    ahead = F.make_dt_interval(F.lit(DEVICE_CLOCK_AHEAD_DAYS))
    behind = F.make_dt_interval(F.lit(DEVICE_CLOCK_BEHIND_DAYS))
    return (device > server + ahead) | (device < server - behind)
