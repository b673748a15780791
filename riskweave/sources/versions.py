"""Tables in versioned folders: a new version appears whole or not at all.

Data go to a folder of their own; then a manifest with the folders of the version's parts is put
in place in one step that fails if that version is there already. Readers take the newest
manifest and keep its folders, which later versions do not touch; a write that fails leaves no
manifest. Of two writers one gets the version and the other tries the next one.

Manifests hold one entry per part: a table has one, an appended table one per append, a table
kept in buckets one per bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS = 12


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Put a file in place as a whole; False if there is one."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    made, files = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(path)
    if files.exists(target):
        return False
    out = files.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(files.makeQualified(made), files.makeQualified(target), how)
    except Exception:
        files.delete(made, False)
        if files.exists(target):
            return False
        raise
    return True


def latest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The newest version and its parts' folders; -1 and none if there is no version."""
    place, files = _file_system(spark, f"{path}/versions")
    if not files.exists(place):
        return -1, {}
    names = [s.getPath().getName() for s in files.listStatus(place)]
    versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    return (max(versions), parts_of(spark, path, max(versions))) if versions else (-1, {})


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/{version:0{_DIGITS}}.json"


def parts_of(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    return json.loads(spark.read.text(_manifest(path, version), wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, version: int, parts: dict[str, str]) -> bool:
    """Make these folders (below ``path``) the version; False if another writer made it."""
    return _put(spark, _manifest(path, version), json.dumps(parts))


def new_folder() -> str:
    return f"data/{uuid.uuid4().hex}"


def _committed(df: DataFrame, path: str, folder: str, change: Callable[[int, dict[str, str]], dict[str, str]]) -> int:
    spark = df.sparkSession
    df.write.parquet(f"{path}/{folder}")
    while True:
        version, parts = latest(spark, path)
        if commit(spark, path, version + 1, change(version + 1, parts)):
            return version + 1


def replace(df: DataFrame, path: str) -> int:
    """Replace the table and its schema; returns the version."""
    folder = new_folder()
    return _committed(df, path, folder, lambda version, parts: {"all": folder})


def append(df: DataFrame, path: str) -> int:
    """Add rows; returns the version, which no other append gets."""
    folder = new_folder()
    return _committed(df, path, folder, lambda version, parts: {**parts, f"{version}": folder})


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default."""
    if version is None:
        version, parts = latest(spark, path)
    else:
        parts = parts_of(spark, path, version)
    if not parts:
        raise FileNotFoundError(f"no version below {path}")
    return spark.read.parquet(*[f"{path}/{folder}" for folder in dict.fromkeys(parts.values())])


def read_appended(spark: SparkSession, path: str, name: str = "version") -> DataFrame:
    """All appended rows with the version in which they came."""
    _, parts = latest(spark, path)
    if not parts:
        raise FileNotFoundError(f"no version below {path}")
    rows = [spark.read.parquet(f"{path}/{folder}").withColumn(name, F.lit(int(version)).cast("long"))
            for version, folder in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
