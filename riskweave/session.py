"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "riskweave", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates.

    The number of shuffle partitions is only a starting point: adaptive execution
    merges small ones and splits skewed ones.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where that costs the next step another shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of the warehouse,
    which executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share. It may be read as long as a DataFrame made
    from it lives, so nothing here deletes it; let the shared folder have a lifetime of its own,
    longer than a run."""
    return f"{shared_folder(spark)}/riskweave/{purpose}-{uuid.uuid4().hex}"


def keep_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the session has a place for them."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint, so that a lost executor repeats nothing
    before it."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows as a Parquet table below the shared folder."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, megabytes: int = 8) -> Iterator[None]:
    """Python functions of jobs that run inside get batches of some megabytes; a larger row comes alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(megabytes << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)
