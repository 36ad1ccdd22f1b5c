"""Row-group statistics read from Parquet footers, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.schemas import SCAN_STATS
from eventlake.sources.files import arrow_location, list_files


def read_row_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per file, row group and column: smallest and largest value as text, compressed
    bytes, and whether all values are NULL. Tasks read footers only, never column data."""

    def footers(batches):
        import pandas as pd
        import pyarrow.parquet as pq

        def text(value):
            if value is None:
                return None
            if isinstance(value, bool):
                return str(value).lower()
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)

        names = ["file", "row_group", "column", "lo", "hi", "bytes", "all_null"]
        for batch in batches:
            for path in batch["path"]:
                fs, inner = arrow_location(path)
                with fs.open_input_file(inner) as source:
                    meta = pq.ParquetFile(source).metadata
                    rows = []
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            chunk = group.column(c)
                            stats = chunk.statistics
                            ranged = stats is not None and stats.has_min_max
                            nulls = (stats.null_count
                                     if stats is not None and stats.has_null_count else None)
                            rows.append((path, g, chunk.path_in_schema,
                                         text(stats.min) if ranged else None,
                                         text(stats.max) if ranged else None,
                                         chunk.total_compressed_size,
                                         nulls is not None and nulls == group.num_rows))
                    yield pd.DataFrame(rows, columns=names)

    paths = list_files(spark, root, "*.parquet").select("path")
    return paths.mapInPandas(footers, schema=SCAN_STATS)
