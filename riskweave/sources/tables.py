"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.sources.schemas import SCHEMAS


BYTES_PER_BATCH = 8 << 30


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Its schema is declared, so no job runs to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table read as a stream of its files, be it one file or a folder of parts. A run
    takes its backlog in micro-batches of about ``BYTES_PER_BATCH``.

    The name is written as a pattern: a stream takes no path of a single file, but a pattern
    that finds one file, or one folder of parts.
    """
    return spark.readStream.schema(SCHEMAS[name]).option("maxBytesPerTrigger", BYTES_PER_BATCH)\
        .parquet(f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}.parquet")


def local_rows(spark: SparkSession, rows: Sequence, schema: StructType | str) -> DataFrame:
    """A small driver-side list as a DataFrame, with a declared schema."""
    return spark.createDataFrame(list(rows), schema)


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name)", args={"name": name})


def overwrite_table(df: DataFrame, table: str, bucket_by: str | None = None, buckets: int = 0) -> None:
    """Replace a catalog table, its schema included.

    Tables bucketed by the same key into the same number of buckets join on it without a
    shuffle; use it for claims and their scores.
    """
    writer = df.write.mode("overwrite")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(table)


def overwrite_path(df: DataFrame, path: str, *partition_columns: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_columns) if partition_columns else writer).parquet(path)


def append_path(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def drop_tables(spark: SparkSession, tables: Sequence[str]) -> list[tuple[str, str]]:
    """Drop every table that exists; go on after an error and report it."""
    outcome = []
    for table in tables:
        try:
            spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": table})
            outcome.append((table, "dropped"))
        except PySparkException as error:
            outcome.append((table, f"skipped: {error.getCondition()}"))
    return outcome


def write_audit(written: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table, expected, actual, ok) per written table, from (source, re-read) pairs."""
    parts = []
    for name, (source, reread) in written.items():
        expected = source.agg(F.count("*")).scalar()
        parts.append(reread.agg(F.count("*").alias("actual")).select(
            F.lit(name).alias("table"), expected.alias("expected"), "actual",
            (expected == F.col("actual")).alias("ok")))
    audit = parts[0]
    for part in parts[1:]:
        audit = audit.unionByName(part)
    return audit


def _marks(df: DataFrame) -> tuple:
    """Row count and a sum of row hashes, which does not depend on the order of rows."""
    return F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum")


def audited_write(sources: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write tables below ``path`` and compare them, read again, with what was written: (table,
    expected, actual, ok). Rows are counted and hashed while they are written, so every source
    runs once; ok says that the count and the hashes of the rows agree."""
    parts = []
    for name, df in sources.items():
        seen = Observation()
        df.observe(seen, *_marks(df)).write.mode("overwrite").parquet(f"{path}/{name}")
        rows, checksum = seen.get["rows"], seen.get["checksum"]
        spark = df.sparkSession
        reread = spark.read.parquet(f"{path}/{name}").select(*df.columns)
        parts.append(reread.agg(*_marks(reread)).select(
            F.lit(name).alias("table"), F.lit(rows).cast("long").alias("expected"), F.col("rows").alias("actual"),
            ((F.col("rows") == rows) & F.equal_null("checksum", F.lit(checksum).cast("decimal(38,0)"))).alias("ok")))
    return reduce(DataFrame.unionByName, parts)


def bind_views(tables: Mapping[str, DataFrame]) -> None:
    """Point a query pack at these tables: one temporary view per table role."""
    for role, df in tables.items():
        df.createOrReplaceTempView(role)


def append_by_date(df: DataFrame, path: str, date_column: str) -> None:
    """Append to a Parquet table partitioned by a date column. Rows are gathered by date, so
    a date gets few files; Spark splits a date with many rows over several writers."""
    df.hint("rebalance", date_column).write.mode("append").partitionBy(date_column).parquet(path)
