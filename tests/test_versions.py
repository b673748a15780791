"""Versioned tables and the snapshot sync."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from riskweave.sources import versions
from riskweave.streaming import sync


def test_a_reader_keeps_its_version_and_the_schema_may_change(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.latest(spark, path) == (-1, {})
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.replace(spark.range(5), path) == 0
    reader = versions.read(spark, path)
    assert versions.replace(spark.createDataFrame([("x", 1.5)], "name string, share double"), path) == 1
    assert sorted(r.id for r in reader.collect()) == list(range(5))
    assert [tuple(r) for r in versions.read(spark, path).collect()] == [("x", 1.5)]
    assert versions.read(spark, path, 0).count() == 5


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(5), path)
    with pytest.raises(Exception, match="no good"):
        versions.replace(spark.range(3).select(F.raise_error(F.lit("no good")).cast("long").alias("id")), path)
    assert versions.latest(spark, path)[0] == 0 and versions.read(spark, path).count() == 5


def test_a_version_is_given_once(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.range(1), path)
    assert not versions.commit(spark, path, 0, {"all": "elsewhere"})
    assert versions.read(spark, path).count() == 1
    path = str(tmp_path / "appended")
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: versions.append(spark.range(i, i + 1), path), range(6)))
    assert sorted(made) == list(range(6))
    rows = versions.read_appended(spark, path)
    assert {r.id: r.version for r in rows.collect()} == dict(enumerate(made))


SCHEMA = "chunk_id string, version long, text string, gone boolean"


def table(spark, path):
    return {r.chunk_id: r.text for r in sync.snapshot_rows(spark, path).collect()}


def test_snapshot_applies_deletions_and_late_changes(spark, tmp_path):
    path = str(tmp_path / "s")

    def apply(number, rows):
        return sync.apply_changes(spark.createDataFrame(rows, SCHEMA), number, path, "chunk_id", "version", F.col("gone"), buckets=8)

    assert apply(0, [("a", 1, "a1", False), ("b", 1, "b1", None), ("a", 2, "a2", False), (None, 1, "n", False)])
    assert table(spark, path) == {"a": "a2", "b": "b1", None: "n"}
    assert apply(1, [("a", 3, None, True), ("c", 1, "c1", False), ("b", 1, "b1", True)])
    assert table(spark, path) == {"c": "c1", None: "n"}
    assert apply(2, [("a", 2, "late", False)]) and table(spark, path) == {"c": "c1", None: "n"}
    assert not apply(2, [("a", 9, "again", False)])  # a repeated batch
    assert table(spark, path) == {"c": "c1", None: "n"}
    assert apply(3, [("a", 4, "back", False)]) and table(spark, path) == {"a": "back", "c": "c1", None: "n"}


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(1000).selectExpr("string(id) AS chunk_id", "1L AS version", "'t' AS text")
    sync.apply_changes(rows, 0, path, "chunk_id", "version")
    _, before = versions.latest(spark, path)
    old = sync.snapshot_rows(spark, path)
    sync.apply_changes(rows.limit(1).withColumns({"version": F.lit(2), "text": F.lit("new")}).selectExpr("chunk_id", "bigint(version) AS version", "text"),
                       1, path, "chunk_id", "version")
    _, after = versions.latest(spark, path)
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    assert sync.snapshot_rows(spark, path).filter("text = 'new'").count() == 1
    assert old.filter("text = 'new'").count() == 0 and sync.snapshot_rows(spark, path).count() == 1000


def test_keys_gone_from_the_source_vanish(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(k, 1, k) for k in "abcd"], "chunk_id string, version long, text string")
    sync.apply_changes(rows, 0, path, "chunk_id", "version")
    assert sync.remove_missing(rows.filter("chunk_id <> 'b'"), path, "chunk_id", "version")
    assert sorted(table(spark, path)) == ["a", "c", "d"]
    assert sync.remove_missing(rows.filter("chunk_id <> 'b'"), path, "chunk_id", "version")
    assert sorted(table(spark, path)) == ["a", "c", "d"]


def test_snapshot_stream_goes_on(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sync.sync_snapshot(stream, path, checkpoint, "chunk_id", "version", F.col("gone")).awaitTermination()
        return table(spark, path)

    assert run([("a", 1, "a1", False), ("b", 1, "b1", False)]) == {"a": "a1", "b": "b1"}
    assert run([("a", 2, None, True), ("c", 1, "c1", False)]) == {"b": "b1", "c": "c1"}
    assert run([("a", 1, "late", False)]) == {"b": "b1", "c": "c1"}
