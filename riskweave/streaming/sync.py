"""Incremental sync of changed rows by primary key.

``sync_changes`` keeps a log: each triggered run appends the changes since the last one, one
folder per micro-batch. A repeated batch overwrites its own folder, so the sync is idempotent.
Readers take the newest change per key; nothing already written is rewritten.

``sync_snapshot`` keeps the synced table itself, in buckets of the key's hash. A batch reads and
writes only the buckets that its keys fall into; the new version names their new folders and the
old ones of all others (``sources/versions.py``), so readers see a batch whole or not at all and
read no log. A batch that is repeated finds its version there and changes nothing. Deleted keys
stay as marked rows, so that a late older change does not bring them back; readers do not see
them. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.joins import removed_keys
from riskweave.sources import versions


def newest_by_key(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key; a null version is the lowest, equal versions are settled by a hash
    of the row. Spark keeps one row per key in each task before it sorts keys over tasks, so a
    key with most of the changes sends no more than any other."""
    newest = Window.partitionBy(key).orderBy(
        F.col(version).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in changes.columns]))
    return changes.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age")


def sync_changes(changes: DataFrame, path: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Write the newest change per key of every micro-batch below ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest_by_key(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merge_changes(spark: SparkSession, path: str, merged_path: str, key: str, version: str) -> None:
    """Write the newest change per key, deletions included, as the first change folder of a
    new path. Later runs with the same checkpoint go on there, and readers read less."""
    newest_by_key(spark.read.parquet(path).drop("batch"), key, version)\
        .write.mode("errorifexists").parquet(f"{merged_path}/batch=-1")


def current_rows(spark: SparkSession, path: str, key: str, version: str,
                 deleted: Column | None = None) -> DataFrame:
    """The synced table: newest change per key, deleted keys left out."""
    changes = spark.read.parquet(path).drop("batch")
    newest = newest_by_key(changes, key, version)
    return newest if deleted is None else newest.filter(~deleted)


#: Buckets of a snapshot: keys are unique in it, so buckets are of about equal size.
BUCKETS = 64
_GONE, _BUCKET = "_gone", "_bucket"


def apply_changes(changes: DataFrame, number: int, path: str, key: str, version: str,
                  deleted: Column | None = None, buckets: int = BUCKETS) -> bool:
    """Merge a batch of changes into the snapshot as its version ``number``; False if that is
    there already. The newest change of a key wins, of equal versions the deletion."""
    spark = changes.sparkSession
    before, parts = versions.latest(spark, path)
    if number <= before:
        return False
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    new = _newest(changes.withColumn(_GONE, gone), key, version).withColumn(_BUCKET, bucket).persist()
    touched = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())
    old = [f"{path}/{parts[str(b)]}" for b in touched if str(b) in parts]
    rows = new
    if old:
        rows = _newest(new.unionByName(spark.read.schema(new.drop(_BUCKET).schema).parquet(*old).withColumn(_BUCKET, bucket)), key, version)
    folder = versions.new_folder()
    rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    new.unpersist()
    return versions.commit(spark, path, number, {**parts, **{str(b): f"{folder}/{_BUCKET}={b}" for b in touched}})


def _newest(changes: DataFrame, key: str, version: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(
        F.col(version).desc_nulls_last(), F.col(_GONE).desc(), F.xxhash64(*[F.col(c) for c in changes.columns if c != _BUCKET]))
    return changes.withColumn("_age", F.row_number().over(newest)).filter("_age = 1").drop("_age")


def snapshot_rows(spark: SparkSession, path: str) -> DataFrame:
    """The synced table: one row per key, deleted keys left out."""
    return versions.read(spark, path).filter(~F.col(_GONE)).drop(_GONE)


def remove_missing(source: DataFrame, path: str, key: str, version: str) -> bool:
    """Delete the keys that the snapshot holds and the source no longer does."""
    spark = source.sparkSession
    current = snapshot_rows(spark, path)
    lost = current.join(removed_keys(current, source, key), key, "left_semi")
    return apply_changes(lost.select(*current.columns), versions.latest(spark, path)[0] + 1, path, key, version, F.lit(True))


def sync_snapshot(changes: DataFrame, path: str, checkpoint: str, key: str, version: str,
                  deleted: Column | None = None, first: int = 0) -> StreamingQuery:
    """Merge every micro-batch into the snapshot below ``path``. Batches are numbered on from
    ``first``, the version that a snapshot has reached by other means."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, first + batch_id, path, key, version, deleted)

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
