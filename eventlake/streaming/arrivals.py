"""The daily job driven by arriving files: whatever landed since the last run is picked up once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import day_from_path
from eventlake.plans.daily_ingest import add_arrivals, ingest_days
from eventlake.schemas import EVENT
from eventlake.sources import hadoop_files as hf
from eventlake.sources.events import stream_landing

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_arrivals(spark: SparkSession, landing: str, root: str, checkpoint: str,
                    after: Callable[[list], None] | None = None) -> int:
    """Clean every day that has new files, then stop. Returns the number of batches.

    The stream only tells which days changed. Each such day is cleaned again from all of its files
    and replaced whole, so late files, re-sent events across files and re-run batches all end in
    the same table."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True)
    # files count however long ago they were written; what was taken before is in the checkpoint
    files = files.option("maxFileAge", "36500d")
    # only paths are looked at here, contents are not read
    arrived = files.load(landing).select(F.to_date(day_from_path(F.col("path"))).alias("day"))
    batches = []

    def clean_touched(batch: DataFrame, batch_id: int) -> None:
        # as many rows as there are days, never more
        days = sorted(r["day"] for r in batch.select("day").distinct().collect())
        if days:
            ingest_days(spark, landing, root, days)
            batches.append(batch_id)
            if after:
                after(days)

    query = (
        arrived.where(F.col("day").isNotNull()).writeStream.foreachBatch(clean_touched)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(batches)


def ingest_arrivals_as_deltas(spark: SparkSession, landing: str, root: str, checkpoint: str,
                              refresh_rollups: bool = False) -> int:
    """Add the events of files that landed since the last run to their days, then stop. Returns the number of batches.

    Each file is read once, and nothing that arrived before is read again; what the table holds in the end is what
    ingest_arrivals() gives. A batch that was cut off is run again and finds its events known. A file that is
    changed in place under its name is not seen; clean such a day whole."""
    batches = []

    def add(batch: DataFrame, batch_id: int) -> None:
        # parsed once here; what follows runs in the caller's session, where plans adapt to the sizes met
        arrived = f"{root}/_incoming/arrived-{uuid.uuid4().hex[:12]}"
        batch.write.option("compression", "zstd").parquet(arrived)
        add_arrivals(spark, spark.read.schema(EVENT).parquet(arrived), landing, root, refresh_rollups)
        hf.drop(spark, arrived)
        batches.append(batch_id)

    query = (stream_landing(spark, landing).writeStream.foreachBatch(add)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return len(batches)
