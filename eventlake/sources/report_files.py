"""Checks and typed scan of report-batch CSV files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from eventlake.schemas import ReportSpec
from eventlake.session import new_scratch
from eventlake.sources import hadoop_files as hf
from eventlake.sources.files import arrow_location, can_read, sniff_files
from eventlake.sources.quoted_csv import RANGE_BYTES, read_quoted

_GZIP_MAGIC = b"\x1f\x8b"
_BATCH_NAME = re.compile(r"[A-Za-z0-9._-]+")

_READ = {"header": True, "escape": '"', "multiLine": True, "mode": "FAILFAST",
         "maxCharsPerColumn": -1, "timeZone": "UTC"}


class BadBatch(Exception):
    """A batch that cannot be loaded as it is; the message says what to mend."""


def batch_name(path: str) -> str:
    """Name of a batch from the name of its file or folder."""
    file_name = path.rstrip("/").rsplit("/", 1)[-1]
    name = file_name.removesuffix(".gz").removesuffix(".csv")
    if not _BATCH_NAME.fullmatch(name):
        raise BadBatch(f"batch name {file_name!r} may hold letters, digits, dot, dash and underscore only")
    return name


def checked_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a batch, each present, not empty and under a name that tells its compression.

    Spark picks the codec by suffix, so a file with a misleading name is first copied under a
    fitting one. The copy runs in tasks, one stream per file, never through the driver."""
    try:
        files = hf.visible_files(spark, path)
    except IsADirectoryError as why:
        raise BadBatch(str(why)) from None
    if not files:
        raise BadBatch(f"there is no file at {path}")
    if empty := [f for f, size in files.items() if size == 0]:
        raise BadBatch(f"{empty[0]} is empty")
    near = [f for f in files if can_read(f)]
    zipped = {r.path: bytes(r.first) == _GZIP_MAGIC for r in sniff_files(spark, near).collect()} if near else {}
    zipped |= {f: hf.first_bytes(spark, f) == _GZIP_MAGIC for f in files if f not in zipped}
    misnamed = [f for f in files if zipped[f] != f.endswith(".gz")]
    if not misnamed:
        return list(files)
    target = new_scratch(spark, "renamed-batch")
    copies = [(f, f"{target}/part-{i:05d}.csv{'.gz' if zipped[f] else ''}")
              for i, f in enumerate(misnamed)]
    _copy_files(spark, copies)
    fitting = dict(copies)
    return [fitting.get(f, f) for f in files]


def _copy_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    def copy(batches):
        import shutil

        for batch in batches:
            for src, dst in zip(batch["src"], batch["dst"]):
                fs_in, inner_in = arrow_location(src)
                fs_out, inner_out = arrow_location(dst)
                fs_out.create_dir(inner_out.rsplit("/", 1)[0])
                with (fs_in.open_input_stream(inner_in, compression=None) as source,
                      fs_out.open_output_stream(inner_out, compression=None) as sink):
                    shutil.copyfileobj(source, sink, 1 << 20)
            yield batch[["dst"]]

    frame = spark.createDataFrame(pairs, "src string, dst string").repartition(len(pairs))
    frame.mapInPandas(copy, "dst string").write.format("noop").mode("overwrite").save()


def header_of(spark: SparkSession, file: str) -> list[str]:
    """Column names of one file."""
    return spark.read.options(**{**_READ, "mode": "PERMISSIVE"}).csv(file).columns


def check_header(columns: list[str], spec: ReportSpec) -> None:
    """Every column of the spec has to be there; more are welcome."""
    missing = sorted(set(spec.file_columns) - set(columns))
    if missing:
        raise BadBatch(f"the header lacks these columns: {', '.join(missing)}")


def read_report_files(spark: SparkSession, files: list[str], spec: ReportSpec, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scan with the types of the spec; columns beyond it are kept as text.

    The first header gives the column order, the tasks hold every other file against it. A plain file is cut over many tasks; a gzip file, or one whose
    quotes do not follow the rules, is one task."""
    columns = header_of(spark, files[0])
    check_header(columns, spec)
    schema = ", ".join(f"`{c}` {spec.file_columns.get(c, 'string')}" for c in columns)
    near = [f for f in files if not f.endswith(".gz") and can_read(f)]
    plain = {r.path: r.length for r in sniff_files(spark, near).collect()} if near else {}
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in _READ.items() if k != "header"}
    cut, odd = read_quoted(spark, plain, columns, schema, options, range_bytes)
    rest = [f for f in files if f not in plain or f in odd]
    parts = [] if cut is None else [cut]
    if rest:
        parts.append(spark.read.options(**_READ).option("enforceSchema", False).schema(schema).csv(rest))
    return reduce(DataFrame.union, parts)
