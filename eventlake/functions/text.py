"""Values that hide in text: durations, counts with a unit, days in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes in one unit.
_MINUTES = {"w": 10_080, "d": 1_440, "h": 60, "m": 1}


def duration_minutes(text: Column) -> Column:
    """Minutes in text such as '2 weeks, 3 days' or '3d 4h'; NULL without any digit.

    A unit is known by its first letter, and the first match of a unit counts."""
    total = F.lit(0).cast("bigint")
    for unit, minutes in _MINUTES.items():
        # most texts lack most units; they are kept from the match, and an empty match from the cast, which would raise and catch an error
        digits = F.when(text.contains(unit), F.regexp_extract(text, rf"(\d+)\s*{unit}", 1))
        total = total + F.coalesce(digits.try_cast("bigint"), F.lit(0)) * minutes
    return F.when(text.rlike(r"\d"), total)


def parse_count(text: Column) -> Column:
    """Row counts written as 10M, 2.5M, 250K, 1b or a plain number; NULL where not positive."""
    clean = F.upper(F.replace(F.trim(text), F.lit("_")))
    digits = F.regexp_extract(clean, r"^(\d+(?:\.\d*)?|\.\d+)[KMB]?$", 1)
    number = F.when(digits != "", digits.try_cast("double"))
    scale = (
        F.when(clean.endswith("K"), 1e3).when(clean.endswith("M"), 1e6).when(clean.endswith("B"), 1e9)
        .otherwise(1.0)
    )
    count = F.floor(number * scale)
    return F.when(count > 0, count)


def day_from_path(path: Column) -> Column:
    """Text of the day in a day=YYYY-MM-DD folder, NULL where the path has none."""
    return F.nullif(F.regexp_extract(path, r"day=(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
