"""File listings and row positions as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, length and modificationTime of every file below one or more folders; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", "length", "modificationTime")


#: Schemes by which Hadoop knows a store, and the name of Arrow's own reader for it.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "hdfs": "hdfs", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def arrow_uri(path: str) -> str:
    """A Hadoop path as Arrow spells it: a plain path for local files, else a URI of a store that it can read."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "file":
        return "/" + rest.lstrip("/")
    if scheme not in ARROW_SCHEMES:
        raise ValueError(f"footers and misnamed files in {scheme}:// cannot be read by tasks, "
                         f"there are readers for {', '.join(sorted(ARROW_SCHEMES))} and local files")
    return f"{ARROW_SCHEMES[scheme]}:{rest}"


def can_read(path: str) -> bool:
    """Whether tasks can read the path by themselves; what they cannot read is left to Spark's readers."""
    scheme, colon, _ = path.partition(":")
    return not colon or "/" in scheme or scheme == "file" or scheme in ARROW_SCHEMES


def arrow_location(path: str):
    """(file system, path in it) for code that runs in tasks."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(arrow_uri(path))


def sniff_files(spark: SparkSession, paths: list[str], tasks: int = 64) -> DataFrame:
    """path, length and the first two bytes of files that tasks can read; looked at by a bounded number of tasks, not by the driver."""

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, inner = arrow_location(path)
                with fs.open_input_file(inner) as file:
                    rows.append({"path": path, "length": file.size(), "first": file.read_at(2, 0)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("first", pa.binary())]))

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), tasks)))
    return listed.mapInArrow(look, "path string, length long, first binary")


def with_row_position(df: DataFrame) -> DataFrame:
    """Add the file a row was read from and its position in that file."""
    return df.withColumns({
        "file": F.col("_metadata.file_path"),
        "row_index": F.col("_metadata.row_index"),
    })


def files_read(df: DataFrame) -> DataFrame:
    """The files rows come from, after partition filters (df.inputFiles() ignores those)."""
    return df.select(F.col("_metadata.file_path").alias("file")).distinct()
