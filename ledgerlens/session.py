"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = None


def get_session(app: str = "ledgerlens", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local master may do without that setting; it gets a folder of its own.
    """
    global _LOCAL_SCRATCH
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="ledgerlens-")
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage.

    Used where several passes need the same expensive aggregate: the source is
    scanned once, and a lost executor costs a re-read instead of a recompute.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def write_once(df: DataFrame, rows_per_file: int = 0, **options: object) -> DataFrame:
    """Like ``materialize``, for tables that grow with the data: a compressed columnar table
    in the shared folder, so that later passes read only the columns they need.

    A file of few bytes is read by one task, however much work its rows are; ``rows_per_file`` cuts such tables into files
    that tasks share. ``options`` go to the Parquet writer."""
    path = scratch_path(df.sparkSession, "table")
    df.write.options(maxRecordsPerFile=rows_per_file, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
