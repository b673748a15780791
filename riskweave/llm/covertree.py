"""Exact top-k inner products by a dual-tree search over a cover tree.

A bounded sample of the vectors gives the tree: every level's centres are apart by half the scale
above and cover all below. Every row, data or query, then belongs to the leaf of its nearest
centre, so both sides are indexed by the same tree; each node's covering radii are measured over
all rows of either side. Node pairs are descended together, from root against root. A pair is
pruned when even the greatest inner product that its balls allow is below the worst k-th score
known in the query node. Neighbouring leaves make blocks of bounded size; a query meets a block if
its leaf survived with one of the block's leaves, and there each leaf is pruned once more by the
query's own k-th score.

K-th scores start from the sample and from each query's own leaf, which is searched first.

A vector takes no part if it or its id is null, or a component is null or not finite. Components
become floor(scale * x); shorter vectors are filled with zeros. Ties go to the smaller id; rows
with a query's own id are no candidates for it; other repeated rows are candidates as often as
they occur. Equal rows of the query set are asked once. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

#: Rows of the sample from which the tree is built (at most), data rows for each of its centres,
#: bytes of a block's vectors and of the queries that meet it at once. Rows sent grow with queries
#: times blocks, so blocks are as large as a task may hold.
CENTRES, ROWS_PER_CENTRE, BLOCK_BYTES = 1024, 512, 8 << 20
#: Scores held in a block before they are cut to the k best of each query.
HELD = 1 << 18
_VECTORS = "vec_id long, vec binary, cell int, far double"


@dataclass
class CoverTree:
    """Nodes with the index of their centre, parent and depth; leaves are the cells in order."""

    points: np.ndarray
    centre: list[int]
    children: list[list[int]]
    cell: list[int]  # of leaves, else -1


def cover_tree(points: np.ndarray) -> CoverTree:
    """Of distinct points. A node's children are centres of its points that are more than half
    its scale apart and cover them; scales halve."""
    tree = CoverTree(points, [], [], [])

    def add(centre: int, cell: int) -> int:
        tree.centre.append(centre)
        tree.children.append([])
        tree.cell.append(cell)
        return len(tree.centre) - 1

    root = add(0, -1)
    todo = [(root, np.arange(len(points)), None)]
    while todo:
        node, members, scale = todo.pop()
        if len(members) == 1:
            tree.cell[node] = int(members[0])
            continue
        away = np.linalg.norm(points[members] - points[tree.centre[node]], axis=1)
        scale = (away.max() if scale is None else min(scale, away.max())) / 2
        nearest, owner, centre = away.copy(), np.zeros(len(members), np.int64), [tree.centre[node]]
        while nearest.max() > scale:
            new = int(nearest.argmax())
            d = np.linalg.norm(points[members] - points[members[new]], axis=1)
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(centre)
            centre.append(int(members[new]))
        for i, c in enumerate(centre):
            child = add(c, -1)
            tree.children[node].append(child)
            todo.append((child, members[owner == i], scale))
    return tree


def _radii(tree: CoverTree, far: np.ndarray) -> np.ndarray:
    """Covering radius of every node, from those of the leaves (-1: no row)."""
    leaves: list[list[int]] = [[] for _ in tree.centre]
    out = np.full(len(tree.centre), -1.0)
    for node in range(len(tree.centre) - 1, -1, -1):
        leaves[node] = [tree.cell[node]] if tree.cell[node] >= 0 else [c for k in tree.children[node] for c in leaves[k]]
        cells = [c for c in leaves[node] if far[c] >= 0]
        if cells:
            away = np.linalg.norm(tree.points[cells] - tree.points[tree.centre[node]], axis=1)
            out[node] = (away + far[cells]).max()
    return out


def surviving(tree: CoverTree, query_far: np.ndarray, data_far: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Pairs (query cell, data cell) that may hold a score of at least the query cell's worst k-th.

    All pairs of one depth are looked at together. At most CENTRES ** 2 pairs.
    """
    q_radius, d_radius = _radii(tree, query_far), _radii(tree, data_far)
    least = np.full(len(tree.centre), np.inf)
    for node in range(len(tree.centre) - 1, -1, -1):
        least[node] = worst[tree.cell[node]] if tree.cell[node] >= 0 else min(least[k] for k in tree.children[node])
    centre = tree.points[tree.centre]
    norm = np.linalg.norm(centre, axis=1)
    pairs, out = np.zeros((1, 2), np.int64), []
    while len(pairs):
        q, d = pairs.T
        most = (centre[q] * centre[d]).sum(1) + norm[q] * d_radius[d] + norm[d] * q_radius[q] + q_radius[q] * d_radius[d]
        most += 1e-9 * (norm[q] + np.abs(q_radius[q])) * (norm[d] + np.abs(d_radius[d])) + 1e-6
        alive = (q_radius[q] >= 0) & (d_radius[d] >= 0) & (most >= least[q])
        deeper = []
        for a, b in pairs[alive].tolist():
            if tree.cell[a] >= 0 and tree.cell[b] >= 0:
                out.append((tree.cell[a], tree.cell[b]))
            elif tree.cell[b] >= 0 or tree.cell[a] < 0 and q_radius[a] > d_radius[b]:
                deeper += [(k, b) for k in tree.children[a]]
            else:
                deeper += [(a, k) for k in tree.children[b]]
        pairs = np.array(deeper, np.int64).reshape(-1, 2)
    return np.array(out, np.int64).reshape(-1, 2)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows. Where sums may leave the whole numbers that a
    double holds, they are taken in Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    wide = [np.array([[int(v) for v in row] for row in x], dtype=object) for x in (a, b)]
    return np.clip(wide[0] @ wide[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _quantizer(dim: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = lists.value_lengths().to_numpy()
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            out = np.zeros((len(lengths), dim))
            out[np.arange(dim) < lengths[:, None]] = values
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in out], pa.binary())], ["vec_id", "vec"])
    return run


def _placer(points: np.ndarray) -> Callable:
    """Nearest centre of every row and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (points ** 2).sum(1)
        for batch in batches:
            x = _matrix(batch.column("vec"), points.shape[1])
            cell = (square - 2 * x @ points.T).argmin(1)
            far = np.linalg.norm(x - points[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(far)],
                ["vec_id", "vec", "cell", "far"])
    return run


def _leaf_order(tree: CoverTree) -> list[int]:
    """Cells in the order of the tree, so that neighbours share ancestors."""
    out, todo = [], [0]
    while todo:
        node = todo.pop()
        if tree.cell[node] >= 0:
            out.append(tree.cell[node])
        todo += reversed(tree.children[node])
    return out


def blocks_of(order: list[int], rows: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first block, number of blocks): runs of cells of at most ``most`` rows together; a
    larger cell is dealt over blocks of its own."""
    out, block, held = [], 0, 0
    for cell in order:
        n = rows.get(cell, 0)
        if not n:
            continue
        if held and held + n > most:
            block, held = block + 1, 0
        count = -(-n // most)
        out.append((cell, block, count))
        held += n
        if count > 1:
            block, held = block + count, 0
    return out


def _best(hits: list[np.ndarray], kth: np.ndarray, k: int) -> np.ndarray:
    """The k best of each query among hits (rows: query, id, score); raises ``kth`` in place."""
    found = np.concatenate(hits, axis=1)
    found = found[:, np.lexsort((found[1], ~found[2], found[0]))]
    first = np.searchsorted(found[0], found[0], side="left")
    place = np.arange(found.shape[1]) - first
    last = found[:, place == k - 1]
    kth[last[0]] = np.maximum(kth[last[0]], last[2])
    return found[:, place < k]


def _seeder(points: np.ndarray, ids: np.ndarray, k: int) -> Callable:
    """Each query's k-th score within the sample, the least long if it has fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            s = products(_matrix(batch.column("vec"), points.shape[1]), points)
            s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            kth = np.sort(s, axis=1)[:, -k] if len(ids) >= k else np.full(len(s), np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(kth)], [*batch.schema.names, "kth"])
    return run


def _meeter(dim: int, k: int, own_leaf: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of data rows and the queries that may find something in it: in their own leaf, or
    in all others."""
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        found = np.empty((3, 0), np.int64)
        own, ask = queries.column("vec_id").to_numpy(), queries.column("ask").to_numpy()
        if data.num_rows and queries.num_rows:
            ids, x, leaf = data.column("vec_id").to_numpy(), _matrix(data.column("vec"), dim), data.column("cell").to_numpy()
            q, home = _matrix(queries.column("vec"), dim), queries.column("cell").to_numpy()
            kth, norm = queries.column("kth").to_numpy().copy(), np.linalg.norm(q, axis=1)
            hits, held = [found], 0
            for cell in np.unique(leaf):
                mine = np.flatnonzero(leaf == cell)
                middle = x[mine].mean(0)
                radius = np.linalg.norm(x[mine] - middle, axis=1).max()
                most = q @ middle + norm * radius + 1e-9 * norm * (np.linalg.norm(middle) + radius) + 1e-6
                may = np.flatnonzero((most >= kth) & ((home == cell) == own_leaf))
                for at in range(0, len(may), 256):
                    rows = may[at:at + 256]
                    for start in range(0, len(mine), 1024):
                        part = mine[start:start + 1024]
                        scores = products(q[rows], x[part])
                        i, j = np.nonzero((scores >= kth[rows][:, None]) & (own[rows][:, None] != ids[part]))
                        hits.append(np.stack([rows[i], ids[part[j]], scores[i, j]]))
                        held += len(i)
                        if held > HELD:
                            hits = [_best(hits, kth, k)]
                            held = hits[0].shape[1]
            found = _best(hits, kth, k)
        row, vec_id, score = found
        return pa.table({"query_id": pa.array(own[row], pa.int64()), "vec_id": pa.array(vec_id, pa.int64()),
                         "score": pa.array(score, pa.int64()), "ask": pa.array(ask[row], pa.int64())})
    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows."""
    spark = vectors.sparkSession
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"))\
        .filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    n, dim = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    whole = good.mapInArrow(_quantizer(dim, scale), "vec_id long, vec binary")
    centres = max(1, min(CENTRES, n // ROWS_PER_CENTRE))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(centres)\
        .mapInArrow(_quantizer(dim, scale), "vec_id long, vec binary").toArrow()
    sample_ids, sampled = sample.column("vec_id").to_numpy(), _matrix(sample.column("vec"), dim)
    points = np.unique(sampled, axis=0)
    tree = cover_tree(points)

    placed = cut_lineage(whole.mapInArrow(_placer(points), _VECTORS))
    queries = placed.filter(is_query).dropDuplicates(["vec_id", "vec"])\
        .withColumn("ask", F.xxhash64("vec_id", "vec"))
    queries = cut_lineage(queries.mapInArrow(_seeder(sampled, sample_ids, k), _VECTORS + ", ask long, kth long"))
    # One row per cell.
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()
    most = max(256, BLOCK_BYTES // (8 * dim))
    groups = -(-max(1, queries.count()) // most)
    # One row per cell: its first block and how many it has.
    blocks = spark.createDataFrame(
        blocks_of(_leaf_order(tree), dict(zip(cells["cell"].tolist(), cells["n"].tolist(), strict=True)), most),
        "cell int, first int, blocks int")
    block_of = (F.col("first") + F.pmod(F.xxhash64("vec_id", "vec"), F.col("blocks"))).cast("int")
    group_of = F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int")
    data = placed.drop("far").join(F.broadcast(blocks), "cell").withColumn("block", block_of).drop("first", "blocks")

    def search(asking: DataFrame, pairs: np.ndarray, own_leaf: bool) -> DataFrame:
        """pairs: query cell, data cell; at most CENTRES ** 2 rows."""
        met = spark.createDataFrame(pa.table({
            "home": pa.array(pairs[:, 0], pa.int32()), "cell": pa.array(pairs[:, 1], pa.int32())}))\
            .join(F.broadcast(blocks), "cell")\
            .select(F.col("home").alias("cell"), F.explode(F.sequence(
                F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block")).distinct()
        there = asking.drop("far").join(met, "cell").withColumn("group", group_of)
        here = data.join(met.select("block").distinct(), "block", "left_semi").withColumn(
            "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return here.groupBy("block", "group").cogroup(there.groupBy("block", "group")).applyInArrow(
            _meeter(dim, k, own_leaf), "query_id long, vec_id long, score long, ask long")

    same = np.stack([cells["cell"], cells["cell"]], 1)
    near = cut_lineage(_top(search(queries, same, True), k).drop("rank"))
    kth = near.groupBy("ask").agg(F.count("*").alias("found"), F.min("score").alias("near_kth"))
    asking = cut_lineage(queries.join(kth, "ask", "left").withColumn(
        "kth", F.when(F.col("found") >= k, F.greatest("kth", "near_kth")).otherwise(F.col("kth")))
        .drop("found", "near_kth"))
    of_cell = asking.groupBy("cell").agg(F.max("far").alias("far"), F.min("kth").alias("kth")).toPandas()
    data_far, query_far = np.full(len(points), -1.0), np.full(len(points), -1.0)
    worst = np.full(len(points), np.inf)
    data_far[cells["cell"]] = cells["far"]
    query_far[of_cell["cell"]] = of_cell["far"]
    worst[of_cell["cell"]] = of_cell["kth"]
    pairs = surviving(tree, query_far, data_far, worst)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    far = search(asking, pairs, False)
    return _top(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")
