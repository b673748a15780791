"""What several operators share: pieces of Arrow batches, hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

#: Rows below this count are at most 16 MB of ids, so a side of that size may be broadcast.
BROADCAST_IDS = 1_000_000


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``max_bytes`` of one column each; a longer
    row is a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total, first = 0, 0
    for at, length in enumerate(lengths.tolist()):
        if at > first and total + length > max_bytes:
            yield batch.slice(first, at - first)
            total, first = 0, at
        total += length
    if first < batch.num_rows:
        yield batch.slice(first)


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Give Python workers whole texts in batches of some megabytes; a longer text comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


@contextlib.contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Queries written inside are planned once, not anew after each shuffle: for many small ones in
    a row, whose plans, not rows, cost time and driver memory."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What a worker remembers from one task to the next, by the operator that uses it.
REMEMBERED: dict[str, dict] = {}


def forget_others(uses: str | None) -> None:
    for name, kept in REMEMBERED.items():
        if name != uses:
            kept.clear()


def tidied(run: Callable, uses: str | None = None) -> Callable:
    """The same mapping of batches; when a task starts, its worker forgets what only other
    operators' tasks remember; when it ends, the worker, which waits for the next task, gives its
    free memory back to the system."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(uses)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_count(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def joined_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (one column of that name, distinct).

    Few ids are broadcast after counting them; more are left to a shuffled join.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): node and component, its least node.

    Each round gives a node the least label among its neighbours and then the label of its
    label, so paths halve. Rounds end when no label changes; labels are cut from their lineage
    by a checkpoint. Nulls and self-links are ignored; a table without links has no nodes.
    """
    links = edges.filter("a <> b")
    both = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))\
        .select("node", F.least("node", "least").alias("component"))
    labels = cut_lineage(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b")\
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(step.join(jump, "component").select("node", "before", F.col("further").alias("component")))
        labels = new.select("node", "component")
        if new.filter("before <> component").isEmpty():
            return labels
