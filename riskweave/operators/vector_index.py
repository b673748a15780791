"""An index of vectors in files that searches read: cells around centres, stored with their radii.

``build`` takes a bounded sample of the vectors as centres, gives every vector to the centre with
the highest cosine and writes the vectors, scaled to length 1, in blocks of one cell each, a folder
per cell; beside them every cell's centre, number of rows and lowest cosine to its centre. All
vectors are indexed; the sample decides only how many cells a search can leave out.

``search`` is exact. A question first visits the cells nearest to it that hold k rows together.
The k-th score found there is a floor: by the angle between question and centre and the cell's
widest angle, a cell has a highest possible score, and cells below the floor are not visited. The
others are, in a second round. Folders of cells that no question visits are not read. A vector is
sent through a shuffle once at most, whatever the number of questions.

A vector or question that is null or empty or holds a null or non-finite component takes no part;
vectors of length 0 have a cell of their own and score 0. Equal scores rank by key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.operators import retrieval
from riskweave.operators.retrieval import BLOCK_BYTES, BROADCAST_BYTES

#: Centres of one vector length; they are sampled, sent to all tasks and kept in the driver.
CENTRES = 1024
#: Bytes of vectors that one task packs.
TASK_BYTES = 128 << 20
#: Room for rounding when a bound is held against a score.
SLACK = 1e-6


def _rows(batch: pa.RecordBatch, size: int, at: np.ndarray) -> np.ndarray:
    return batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


@dataclass
class _Cells:
    """Cells of vectors of one length; the last one is that of vectors of length 0."""
    number: np.ndarray
    centre: np.ndarray
    rows: np.ndarray
    least: np.ndarray

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector its cell's place and its cosine to the centre."""
        cosine = units @ self.centre.T
        cosine[:, -1] = -2.0
        place = cosine.argmax(1)
        best = cosine[np.arange(len(units)), place]
        zero = ~units.any(1)
        place[zero], best[zero] = len(self.number) - 1, 1.0
        return place, best

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine to every centre, and the highest score that a row of every cell can have."""
        cosine = np.clip(units @ self.centre.T, -1.0, 1.0)
        apart = np.arccos(cosine) - np.arccos(np.clip(self.least, -1.0, 1.0))
        bound = np.cos(np.clip(apart, 0.0, math.pi))
        bound[:, -1] = 0.0
        bound[~units.any(1)] = 0.0
        return cosine, bound


def _assigner(cells: dict[int, _Cells]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                units = retrieval._unit_rows(_rows(batch, size, at))
                place, cosine = cells[size].nearest(units)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(units.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size, np.int32)), pa.array(cells[size].number[place].astype(np.int32)),
                     batch.column("key").take(pa.array(at)), vectors, pa.array(cosine)], ["size", "cell", "key", "vector", "cosine"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their cells as blocks of one cell, in order of their keys."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.take(pc.sort_indices(table.column("key"), null_placement="at_start")).combine_chunks()
        values = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        keys = part.column("key").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        columns = [pa.array([part.column("size")[0].as_py()], pa.int32()), pa.array([part.num_rows], pa.int64()),
                   pa.array([pc.min(part.column("cosine")).as_py()]),
                   pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), keys),
                   pa.array([values.astype(np.float64).tobytes()], pa.binary()), pa.array([part.column("cell")[0].as_py()], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["size", "n", "least", "keys", "block", "cell"])

    for batch in batches:
        cell = batch.column("cell").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            step = max(1, BLOCK_BYTES // (8 * batch.column("size")[a].as_py())) if b > a else 1
            while a < b:
                if held and held[0].column("cell")[0].as_py() != cell[a]:
                    yield block()
                    held, rows = [], 0
                some = batch.slice(a, min(b - a, step - rows))
                held.append(some)
                rows, a = rows + some.num_rows, a + some.num_rows
                if rows >= step:
                    yield block()
                    held, rows = [], 0
    if held:
        yield block()


def build(vectors: DataFrame, path: str) -> None:
    """Write the index of a table of a key and a vector column below ``path``."""
    spark = vectors.sparkSession
    (key, key_type), (vector, _) = vectors.dtypes
    usable = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))\
        .filter(retrieval._usable(F.col("vector"))).withColumn("size", F.size("vector"))
    counts = {r.size: r["count"] for r in usable.groupBy("size").count().collect()}
    order = Window.partitionBy("size").orderBy(F.xxhash64("vector"), "key")
    sample = usable.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= CENTRES)\
        .select("size", "_place", "vector").collect()
    cells: dict[int, _Cells] = {}
    first = 0
    for size, n in sorted(counts.items()):
        wanted = min(CENTRES, math.isqrt(n - 1) + 1)
        centre = np.array([r.vector for r in sorted(sample, key=lambda r: r["_place"]) if r.size == size][:wanted], float)
        centre = np.unique(retrieval._unit_rows(centre), axis=0)
        centre = np.vstack([centre[centre.any(1)], np.zeros((1, size))])
        cells[size] = _Cells(np.arange(first, first + len(centre)), centre, np.zeros(len(centre)), np.ones(len(centre)))
        first += len(centre)
    total = sum(8 * size * n for size, n in counts.items())
    assigned = usable.select("key", "vector").mapInArrow(
        _assigner(cells), f"size int, cell int, key {key_type}, vector array<double>, cosine double")
    # Sorted by cell and hash: a cell with most rows is spread over many tasks.
    spread = assigned.withColumn("_spread", F.xxhash64("key"))
    packed = spread.repartitionByRange(max(1, -(-total // TASK_BYTES)), "cell", "_spread").sortWithinPartitions("cell", "_spread")\
        .drop("_spread").mapInArrow(_pack, f"size int, n long, least double, keys array<{key_type}>, block binary, cell int")
    packed.write.partitionBy("cell").parquet(f"{path}/blocks")
    written = spark.read.schema(_blocks_schema(key_type)).parquet(f"{path}/blocks")
    found = {r.cell: (r.n, r.least) for r in written.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect()}
    rows = [(int(size), int(number), [float(x) for x in centre], *found[int(number)])
            for size, c in cells.items() for number, centre in zip(c.number, c.centre, strict=True) if int(number) in found]
    spark.createDataFrame(rows, "size int, cell int, centre array<double>, n long, least double")\
        .withColumn("key_type", F.lit(key_type)).coalesce(1).write.parquet(f"{path}/cells")


def _blocks_schema(key_type: str) -> str:
    return f"size int, n long, least double, keys array<{key_type}>, block binary, cell int"


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, str, dict[int, _Cells]]:
    """Blocks, the type of keys and the cells by length, at most ``CENTRES`` and one of each."""
    rows = spark.read.parquet(f"{path}/cells").collect()
    key_type = rows[0].key_type if rows else "long"
    cells = {}
    for size in sorted({r.size for r in rows}):
        mine = sorted((r for r in rows if r.size == size), key=lambda r: r.cell)
        zero = next((r for r in mine if not any(r.centre)), None)
        mine = [r for r in mine if r is not zero]
        cells[size] = _Cells(
            np.array([r.cell for r in mine] + [zero.cell if zero else -1]),
            np.array([r.centre for r in mine] + [[0.0] * size]),
            np.array([r.n for r in mine] + [zero.n if zero else 0]), np.array([r.least for r in mine] + [1.0]))
    return spark.read.schema(_blocks_schema(key_type)).parquet(f"{path}/blocks"), key_type, cells


def vectors_of(spark: SparkSession, path: str) -> DataFrame:
    """key and vector, scaled to length 1, of all that is indexed."""
    blocks, key_type, _ = _blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, size = batch.column("keys")[i].values, batch.column("size")[i].as_py()
                values = np.frombuffer(batch.column("block")[i].as_buffer(), np.float64)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1, dtype=np.int32) * size), pa.array(values))], ["key", "vector"])
    return blocks.select("size", "keys", "block").mapInArrow(run, f"key {key_type}, vector array<double>")


def _visits(cells: dict[int, _Cells], k: int, later: bool) -> Callable:
    """(cell, query_id, vector): the first cells of every question, or those that its floor leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for size in set(np.unique(lengths).tolist()) & set(cells):
                at, mine = np.flatnonzero(lengths == size), cells[size]
                cosine, bound = mine.bounds(retrieval._unit_rows(_rows(batch, size, at)))
                cosine[:, -1] = 0.0
                order = np.argsort(-cosine, axis=1, kind="stable")
                before = np.cumsum(mine.rows[order], axis=1) - mine.rows[order]
                visit = np.zeros_like(cosine, bool)
                np.put_along_axis(visit, order, before < k, axis=1)
                if later:
                    floor = batch.column("floor").take(pa.array(at)).to_numpy(zero_copy_only=False)
                    visit = ~visit & (bound >= floor[:, None] - SLACK)
                visit &= mine.rows > 0
                question, cell = np.nonzero(visit)
                rows = pa.array(at[question])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine.number[cell].astype(np.int32)), batch.column("query_id").take(rows), batch.column("vector").take(rows)],
                    ["cell", "query_id", "vector"])
    return run


def _best_of(blocks: DataFrame, visits: DataFrame, key_type: str, query_type: str, k: int) -> DataFrame:
    """The k best rows of every question in the cells it visits."""
    visits = visits.persist()
    per_cell = visits.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).collect()
    size = sum(8 * r.n * r["size"] for r in per_cell)
    # Questions of one cell in groups of bounded size.
    groups = max([1, *(-(-8 * r.n * r["size"] // BLOCK_BYTES) for r in per_cell)])
    grouped = visits.groupBy("cell", F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)).alias("group"))\
        .agg(F.collect_list(F.struct("query_id", "vector")).alias("asked")).drop("group")
    met = blocks.filter(F.col("cell").isin([r.cell for r in per_cell]))\
        .join(F.broadcast(grouped) if size <= BROADCAST_BYTES else grouped, "cell")
    found = met.select("size", "keys", "block", "asked")\
        .mapInArrow(retrieval._best_of_block(k), f"query_id {query_type}, key {key_type}, score double")
    return retrieval.best_by_query(found, k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = V.RETRIEVAL_DEPTH) -> DataFrame:
    """The k nearest indexed vectors of every question by cosine: (query_id, key, score, rank)."""
    blocks, key_type, cells = _blocks(spark, path)
    (query, query_type), (asked, _) = queries.dtypes
    questions = queries.select(F.col(query).alias("query_id"), F.col(asked).cast("array<double>").alias("vector"))\
        .filter(retrieval._usable(F.col("vector")))
    schema = f"cell int, query_id {query_type}, vector array<double>"
    first = _best_of(blocks, questions.mapInArrow(_visits(cells, k, False), schema), key_type, query_type, k).persist()
    floors = first.groupBy(F.col("query_id").alias("_asked")).agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("floor"))
    floored = questions.join(floors, F.col("query_id").eqNullSafe(F.col("_asked")), "left")\
        .select("query_id", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    second = _best_of(blocks, floored.mapInArrow(_visits(cells, k, True), schema), key_type, query_type, k)
    return retrieval.best_by_query(first.unionByName(second).drop("rank"), k)
