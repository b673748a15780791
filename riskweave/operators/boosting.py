"""Boosted trees for a yes/no label, grown by leaf from distributed histograms.

Features are cut into at most ``BINS`` ordered bins once and packed into blocks of rows, which are
dealt evenly to the tasks. A tree is grown in passes over the blocks, one per level: every task sums
gradients per (node, feature, bin) of its rows, Spark adds the tasks' sums up, and the driver, which
sees those sums only, picks splits. A pass sums the smaller child of each split; the other is its
parent's sums less those. All nodes of a level are split ahead; then leaves are opened by falling
gain until the tree has its number of leaves. That is the tree which opening leaf after leaf gives,
in as many passes as it has levels.

Passes are many and short, so blocks are an RDD: a pass over it is one job of one stage, without a
query to plan and, up to ``ADDED_AT_ONCE`` tasks, without a shuffle.

Gradients are whole numbers (2 ** SCALE to one), so sums, and with them the model, do not depend
on how rows are dealt or on retried tasks. Scores and gradients are worked out once per tree and
kept in the blocks, which are checkpointed every ``KEPT_TREES`` trees, so no lineage grows.

Numbers are ordered as such, nulls and NaN first; categories by their text, so that a cut of
codes in text order is a cut of the texts themselves and values never seen have a place. Rows
without a label take no part in a fit. Each class has the same total weight.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranks import sorted_positions
from riskweave.session import keep_checkpoints, written

BINS = 255
SCALE = 20
BLOCK_ROWS, TASK_ROWS, KEPT_TREES = 1 << 15, 1 << 16, 10
#: Tasks whose sums the driver adds up itself; of more, tasks add them up first.
ADDED_AT_ONCE = 32
LEAST_HESSIAN = 1e-3
_BLOCK = "bins binary, labels binary"


@dataclass
class Tree:
    """Nodes by number, the root is 0. ``left`` is -1 for a leaf; rows whose bin is at most
    ``bin`` go left, others to ``left + 1``."""
    feature: list[int]
    bin: list[int]
    left: list[int]
    value: list[float]

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        node = np.zeros(len(bins), np.int64)
        open_ = np.arange(len(bins)) if left[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            at = node[open_]
            node[open_] = left[at] + (bins[open_, feature[at]] > cut[at])
            open_ = open_[left[node[open_]] >= 0]
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(bins)]


@dataclass
class Booster:
    """Numeric and text features in order, each one's cuts (first value of every bin but the
    first) and the trees."""
    features: list[str]
    texts: list[str]
    cuts: list[list]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.empty((batch.num_rows, len(self.features)), np.uint8)
        for i, (name, cuts) in enumerate(zip(self.features, self.cuts, strict=True)):
            column = batch.column(batch.schema.get_field_index(name))
            if name in self.texts:
                coded = column.dictionary_encode()
                places = np.searchsorted(np.array(cuts, object), np.array(coded.dictionary.to_pylist(), object), "right")
                out[:, i] = places[coded.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else 0
            else:
                values = pc.fill_null(column, float("-inf")).to_numpy(zero_copy_only=False)
                out[:, i] = np.searchsorted(np.array(cuts, float), np.where(np.isnan(values), -np.inf, values), "right")
        return out

    def probability(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.trees:
            total += tree.scores(bins)
        return 1 / (1 + np.exp(-total))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Booster:
        made = json.loads(text)
        return Booster(made["features"], made["texts"], made["cuts"], [Tree(**t) for t in made["trees"]])


def ready(features: DataFrame, names: Sequence[str], texts: Sequence[str]) -> list:
    """The feature columns as doubles and texts; a null text is the text None."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) if c in texts else F.col(c).cast("double").alias(c)
            for c in names]


def bin_cuts(features: DataFrame, names: Sequence[str], texts: Sequence[str], bins: int = BINS) -> list[list]:
    """Per feature, the first value of every bin but the first. A feature of at most ``bins``
    values has a bin for each; of more, bins of about equal numbers of rows. Only values that
    differ are sorted, and only cuts reach the driver."""
    columns = dict(zip(names, ready(features, names, texts), strict=True))
    # Numbers and texts side by side in one value, so all features are counted and sorted at once.
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.struct(
        (F.lit(None) if c in texts else columns[c]).cast("double").alias("number"),
        (columns[c] if c in texts else F.lit(None)).cast("string").alias("text")).alias("value")) for c in names]))
    known = (F.col("p.value.number").isNotNull() & ~F.isnan("p.value.number")) | F.col("p.value.text").isNotNull()
    counts = features.select(pairs.alias("p")).filter(known).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))
    placed = sorted_positions(counts, "feature", "value", {"before": F.col("n"), "values_before": F.lit(1)})
    totals = placed.groupBy("feature").agg(F.sum("n").alias("_rows"), F.count("*").alias("_values"))
    number = F.when(F.col("_values") <= bins, F.col("values_before")).otherwise(F.expr(f"before * {bins} div _rows"))
    firsts = placed.join(F.broadcast(totals), "feature").groupBy("feature", number.alias("bin"))\
        .agg(F.min("value").alias("value"))
    found: dict[str, list] = {c: [] for c in names}
    for row in firsts.orderBy("feature", "bin").collect():  # at most ``bins`` rows a feature
        found[row.feature].append(row.value.text if row.feature in texts else row.value.number)
    return [found[c][1:] for c in names]


def _packer(model: Booster) -> Callable:
    """Blocks of rows; the bins of a block stand feature by feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, rows = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                np.concatenate(held).T.tobytes(), np.concatenate(labels).tobytes())], ["bins", "labels"])

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                held.append(model.binned(batch))
                labels.append(batch.column("label").to_numpy().astype(np.uint8))
                rows += batch.num_rows
                if rows >= BLOCK_ROWS:
                    yield block()
                    held, labels, rows = [], [], 0
        if rows:
            yield block()
    return run


@dataclass
class _Block:
    """Rows of a fit: bins, feature by feature, labels, scores so far and what a tree sums up."""
    bins: bytes
    labels: bytes
    scores: bytes
    g: bytes
    h: bytes

    def opened(self, width: int) -> np.ndarray:
        return np.frombuffer(self.bins, np.uint8).reshape(width, -1)


def _gradients(bins: bytes, labels: bytes, scores: np.ndarray, weights: tuple[float, float]) -> _Block:
    label = np.frombuffer(labels, np.uint8)
    p, weight = 1 / (1 + np.exp(-scores)), np.array(weights)[label]
    g, h = (np.rint(x * weight * (1 << SCALE)).astype(_whole(weights)) for x in (p - label, p * (1 - p)))
    return _Block(bins, labels, scores.tobytes(), g.tobytes(), h.tobytes())


def _whole(weights: tuple[float, float]) -> type:
    """The type that holds every gradient of a row."""
    return np.int32 if max(weights) < 1 << 10 else np.int64


def _started(weights: tuple[float, float]) -> Callable:
    return lambda row: _gradients(bytes(row.bins), bytes(row.labels), np.zeros(len(row.labels)), weights)


def _scored(width: int, weights: tuple[float, float], tree: Tree) -> Callable:
    """A block with one more tree."""
    def run(block: _Block) -> _Block:
        scores = np.frombuffer(block.scores, np.float64).copy()
        for node, rows in _dealt(tree, block.opened(width)):
            scores[rows] += tree.value[node]
        return _gradients(block.bins, block.labels, scores, weights)
    return run


def _dealt(tree: Tree, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every leaf that has rows of a block, with them."""
    open_ = [(0, np.arange(bins.shape[1]))]
    while open_:
        node, rows = open_.pop()
        if tree.left[node] < 0:
            yield node, rows
            continue
        above = bins[tree.feature[node]][rows] > tree.bin[node]
        for child, mine in ((tree.left[node], rows[~above]), (tree.left[node] + 1, rows[above])):
            if len(mine):
                open_.append((child, mine))


def _summer(width: int, weights: tuple[float, float], grown: Tree, wanted: list[int]) -> Callable:
    """Sums (g, h, n) of the rows at the wanted nodes of the tree grown so far."""
    def run(blocks: Iterator[_Block]) -> Iterator[np.ndarray]:
        total = np.zeros((len(wanted), 3, width, BINS + 1), np.int64)
        place = {node: i for i, node in enumerate(wanted)}
        for block in blocks:
            bins = block.opened(width)
            g, h = (np.frombuffer(x, _whole(weights)) for x in (block.g, block.h))
            for node, rows in _dealt(grown, bins):
                if node in place:
                    mine, of = total[place[node]], (g[rows].astype(np.float64), h[rows].astype(np.float64), None)
                    for f in range(width):
                        cell = bins[f][rows]
                        for kind, values in enumerate(of):
                            mine[kind, f] += np.bincount(cell, values, BINS + 1).astype(np.int64)
        yield total
    return run


@dataclass
class _Node:
    depth: int
    sums: np.ndarray | None  # (g, h, n) by feature and bin
    total: np.ndarray  # (g, h, n)
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    left: np.ndarray | None = None
    children: int = -1


def _find_split(node: _Node, least_rows: int) -> None:
    """The split of highest gain; of equal ones the first feature's, then the lowest bin's."""
    below = np.cumsum(node.sums, axis=2)[:, :, :-1].astype(np.float64)
    whole = node.total.astype(np.float64)[:, None, None]
    above = whole - below
    one = float(1 << SCALE)
    good = (below[2] >= least_rows) & (above[2] >= least_rows) & (below[1] >= LEAST_HESSIAN * one) & (above[1] >= LEAST_HESSIAN * one)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[0] ** 2 / below[1] + above[0] ** 2 / above[1] - whole[0] ** 2 / whole[1]
    gain = np.where(good, gain, 0.0)
    at = int(gain.argmax())
    if gain.flat[at] > 1e-9 * one:
        node.feature, node.bin = divmod(at, gain.shape[1])
        node.gain = float(gain.flat[at])
        node.left = np.cumsum(node.sums, axis=2)[:, node.feature, node.bin]


def _collected(blocks: RDD, width: int, weights: tuple[float, float], grown: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
    sums = blocks.mapPartitions(_summer(width, weights, grown, wanted))
    few = blocks.getNumPartitions() <= ADDED_AT_ONCE
    total = functools.reduce(np.add, sums.collect()) if few else sums.treeReduce(np.add, 2)
    return dict(zip(wanted, total, strict=True))


def _grow(blocks: RDD, width: int, weights: tuple[float, float], leaves: int, max_depth: int, least_rows: int,
          step: float) -> Tree:
    ahead = Tree([-1], [-1], [-1], [0.0])  # all splits made ahead
    nodes: list[_Node] = []
    root = _collected(blocks, width, weights, ahead, [0])[0]
    nodes.append(_Node(0, root, root[:, 0].sum(1)))
    level = [0]
    while level:
        split = []
        for i in level:
            node = nodes[i]
            if node.depth < max_depth:
                _find_split(node, least_rows)
            if node.gain:
                node.children = len(nodes)
                ahead.feature[i], ahead.bin[i], ahead.left[i] = node.feature, node.bin, node.children
                for total in (node.left, node.total - node.left):
                    nodes.append(_Node(node.depth + 1, None, total))
                    for values in (ahead.feature, ahead.bin, ahead.left):
                        values.append(-1)
                split.append(i)
        ahead.value = [0.0] * len(nodes)
        level = [c for i in split for c in (nodes[i].children, nodes[i].children + 1)]
        if not level or nodes[level[0]].depth >= max_depth:
            break
        small = {i: nodes[i].children + int(nodes[nodes[i].children].total[2] > nodes[nodes[i].children + 1].total[2]) for i in split}
        found = _collected(blocks, width, weights, ahead, list(small.values()))
        for i, child in small.items():
            other = 2 * nodes[i].children + 1 - child
            nodes[child].sums, nodes[other].sums = found[child], nodes[i].sums - found[child]
    return _opened_by_gain(nodes, leaves, step)


def _opened_by_gain(nodes: list[_Node], leaves: int, step: float) -> Tree:
    """Leaves opened by falling gain, the earlier node of equal ones first."""
    tree, number = Tree([], [], [], []), {}

    def leaf(i: int) -> None:
        number[i] = len(tree.left)
        g, h, _ = nodes[i].total.tolist()
        for values, x in ((tree.feature, -1), (tree.bin, -1), (tree.left, -1), (tree.value, -step * g / h if h else 0.0)):
            values.append(x)

    leaf(0)
    heap, count = [(-nodes[0].gain, 0)], 1
    while heap and count < leaves:
        gain, i = heapq.heappop(heap)
        if not gain:
            break
        at, node = number[i], nodes[i]
        tree.feature[at], tree.bin[at], tree.left[at] = node.feature, node.bin, len(tree.left)
        for child in (node.children, node.children + 1):
            leaf(child)
            heapq.heappush(heap, (-nodes[child].gain, child))
        count += 1
    return tree


def fit(train: DataFrame, features: Sequence[str], texts: Sequence[str], label: str, trees: int = 200, leaves: int = 31,
        max_depth: int = 6, step: float = 0.05, least_rows: int = 20) -> Booster:
    known = train.filter(F.col(label).isNotNull())
    # Written once: cuts, weights and blocks read it, and the joins and splits before it run once.
    rows = written(known.select(*ready(known, features, texts), F.col(label).cast("int").alias("label")), "train")
    model = Booster(list(features), list(texts), bin_cuts(rows, features, texts))
    no, yes = (int(n or 0) for n in rows.agg(F.sum(1 - F.col("label")), F.sum("label")).first())
    tasks = max(1, min(-(-(no + yes) // TASK_ROWS), train.sparkSession.sparkContext.defaultParallelism))
    weights = tuple((no + yes) / (2.0 * n) if n else 0.0 for n in (no, yes))
    width = len(features)
    if not no + yes:
        return model
    keep_checkpoints(train.sparkSession)
    packed = rows.mapInArrow(_packer(model), _BLOCK).repartition(tasks)
    blocks, earlier = _kept(packed.rdd.map(_started(weights)), True), None
    for i in range(trees):
        model.trees.append(_grow(blocks, width, weights, leaves, max_depth, least_rows, step))
        if earlier:
            earlier.unpersist()
        # The next tree's first pass works its blocks out of these.
        further = blocks.map(_scored(width, weights, model.trees[-1]))
        earlier, blocks = blocks, _kept(further, (i + 1) % KEPT_TREES == 0)
    if earlier:
        earlier.unpersist()
    blocks.unpersist()
    return model


def _kept(blocks: RDD, cut: bool) -> RDD:
    """Cached; with ``cut``, a lost executor's part is read from a checkpoint again."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    if cut:
        blocks.checkpoint()
    return blocks


def root_histogram(model: Booster, train: DataFrame, label: str) -> DataFrame:
    """feature, bin, rows, flagged: what a first tree's root sums up, nulls in their bin 0."""
    known = train.filter(F.col(label).isNotNull())
    rows = known.select(*ready(known, model.features, model.texts), F.col(label).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(model.features), BINS + 1), np.int64)
        for batch in batches:
            bins, yes = model.binned(batch), batch.column("label").to_numpy() == 1
            for f in range(len(model.features)):
                total[0, f] += np.bincount(bins[:, f], minlength=BINS + 1)
                total[1, f] += np.bincount(bins[yes, f], minlength=BINS + 1)
        feature, cell = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.features[f] for f in feature.tolist()], pa.string()), pa.array(cell.astype(np.int32)),
             pa.array(total[0, feature, cell]), pa.array(total[1, feature, cell])], ["feature", "bin", "rows", "flagged"])
    sums = rows.mapInArrow(run, "feature string, bin int, rows long, flagged long")
    return sums.groupBy("feature", "bin").agg(F.sum("rows").alias("rows"), F.sum("flagged").alias("flagged"))


def predict(model: Booster, rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The kept columns and the probability of a yes."""
    fields = [rows.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f"_kept{i}") for i in range(len(fields))), pa.array(model.probability(model.binned(batch)))],
                [*kept, "probability"])
    schema = rows.select(*kept).schema.add("probability", "double")
    return rows.select(*[F.col(c).alias(f"_kept{i}") for i, c in enumerate(kept)],
                       *ready(rows, model.features, model.texts)).mapInArrow(run, schema)
