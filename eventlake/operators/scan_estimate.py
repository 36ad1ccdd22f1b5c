"""How much a question has to read, worked out from row-group statistics before it runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.fixed_values import MIN_BILLED_MB, USD_PER_TB
from eventlake.functions import day_from_path

Range = tuple[object, object]


def cannot_match(lo: Column, hi: Column, want: Range) -> Column:
    """True where [lo, hi] misses the wanted range. Compared as numbers if all four are numbers,
    as text otherwise. Unknown bounds can always match."""
    want_lo, want_hi = F.lit(str(want[0])), F.lit(str(want[1]))
    numbers = [c.try_cast("double") for c in (want_lo, want_hi, lo, hi)]
    as_numbers = (numbers[1] < numbers[2]) | (numbers[0] > numbers[3])
    as_text = (want_hi < lo) | (want_lo > hi)
    all_numbers = numbers[0].isNotNull()
    for n in numbers[1:]:
        all_numbers = all_numbers & n.isNotNull()
    known = lo.isNotNull() & hi.isNotNull()
    return F.coalesce(known & F.when(all_numbers, as_numbers).otherwise(as_text), F.lit(False))


def kept_row_groups(stats: DataFrame, columns: Sequence[str], filters: Mapping[str, Range]) -> DataFrame:
    """Row groups that have to be read: file, row_group, bytes of the wanted columns.

    One aggregation over the statistics. A filter on a column that a row group does not have is
    ignored, except that a day may also come from the folder name."""
    measures = [F.sum(F.when(F.col("column").isin(*columns), F.col("bytes")).otherwise(0)).alias("bytes")]
    skip = F.lit(False)
    for i, (name, want) in enumerate(filters.items()):
        here = F.col("column") == name
        missed = here & (F.col("all_null") | cannot_match(F.col("lo"), F.col("hi"), want))
        measures.append(F.bool_or(missed).alias(f"missed_{i}"))
        misses = F.col(f"missed_{i}")
        if name == "day":
            measures.append(F.bool_or(here).alias("stores_day"))
            folder = day_from_path(F.col("file"))
            misses = F.when(F.col("stores_day"), misses).otherwise(cannot_match(folder, folder, want))
        skip = skip | misses
    grouped = stats.groupBy("file", "row_group").agg(*measures)
    return grouped.where(~skip).select("file", "row_group", "bytes")


def estimate_scan(stats: DataFrame, columns: Sequence[str], filters: Mapping[str, Range]) -> DataFrame:
    """One row: bytes to read and files touched."""
    return kept_row_groups(stats, columns, filters).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.countDistinct("file").alias("files"),
    )


def whole_file_cost(files: DataFrame) -> DataFrame:
    """Bytes and files where nothing can be skipped, such as CSV; takes a file listing."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def whole_file_cost_per_layout(files: DataFrame) -> DataFrame:
    """The same for each layout and roll-up of layout_files(): what one question that reads all of it costs."""
    costs = files.groupBy("layout").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))
    return costs.withColumn("usd_per_1000", usd_per_1000(F.col("bytes") / 1e6))


def usd_per_1000(mb: Column) -> Column:
    """Price of a thousand such queries on an engine that bills per byte scanned."""
    return F.greatest(mb, F.lit(float(MIN_BILLED_MB))) / 1e6 * USD_PER_TB * 1000
