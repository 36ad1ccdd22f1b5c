"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "eventlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for. Cluster sizing stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256MB")
        # no call-site lookup per Column operation; it costs more than planning a small question
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset and Spark runs on this machine alone, a local temporary folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="eventlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created until something is written."""
    return f"{shared_dir(spark)}/eventlake/{label}-{uuid.uuid4().hex[:12]}"


def compute_once(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that later actions read the same rows even if
    executors are lost in between."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
