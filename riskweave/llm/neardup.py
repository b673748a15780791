"""Near-duplicate groups by b-bit MinHash.

A text's set is its distinct word shingles. Equal sets are merged first, so exact copies cost
one sketch. Each set gets minima under many permutations; bands of minima give candidates, and
of every minimum only the low bits are kept, packed into a signature. The number of equal packed
minima, corrected for the chance that unequal minima agree in so few bits, estimates the
similarity; pairs that may reach the threshold are confirmed on the full sets.

No bucket's pairs are written out. First each member meets the bucket's hub, which joins nearly
all copies of a group. Then only members of different components in a bucket are left to meet:
blocks of bounded size compare them inside a task and return a spanning forest of the links
found there.

Nulls and empties: a null or wordless text has an empty set, is linked with nothing and is its
own component. A row without doc_id is kept, has a null component and takes part in no link.
Rows that share a doc_id count as one document. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import BROADCAST_IDS, components, joined_ids, mixed, slices, tidied
from riskweave.session import cut_lineage, written


@dataclass(frozen=True)
class MinHash:
    """shingle: words in a shingle. percent: least similarity in hundredths. bands x rows: minima.
    With 26 x 5, two sets at 0.85 share no band once in 4 million, at 0.8 once in 34,000.
    bits: kept of each minimum. slack: standard deviations by which an estimate may fall short.
    block: members, and weight: shingles, of one side of a block at most (a longer text alone)."""

    shingle: int = 5
    percent: int = 80
    bands: int = 26
    rows: int = 5
    bits: int = 4
    slack: float = 6.0
    block: int = 1024
    weight: int = 2_000_000

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def least_equal(self) -> int:
        """Equal packed minima below which a pair can't be a link."""
        chance = 2.0 ** -self.bits
        share = self.percent / 100 + (1 - self.percent / 100) * chance
        spread = self.slack * (share * (1 - share) * self.minima) ** 0.5
        return max(0, int(share * self.minima - spread))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at \\x20 and \\x09-\\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    s = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        s = mixed(s + h[i:len(h) - size + 1 + i])
    return np.unique(s)


def _permutations(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    draws = mixed(np.arange(1, 2 * p.minima + 1, dtype=np.uint64)).astype(np.uint32)
    return draws[:p.minima] | np.uint32(1), draws[p.minima:]


def _minima(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low, out = (shingles >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), 512):
        part = (low[at:at + 512, None] * factors + offsets).min(0)
        out = part if out is None else np.minimum(out, part)
    return out


def _packed(minima: np.ndarray, bits: int) -> bytes:
    """The low bits of every minimum, one after another."""
    low = (minima[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(low.astype(np.uint8)).tobytes()


def _sketcher(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _permutations(p)
        band = mixed(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = rows.column("text").cast(pa.binary()).to_pylist()
                counts, digests, keys, signatures = [], [], [], []
                for text in texts:
                    s = shingle_set(text or b"", p.shingle)
                    counts.append(len(s))
                    if not len(s):
                        digests.append(None)
                        keys.append(None)
                        signatures.append(None)
                        continue
                    m = _minima(s, factors, offsets)
                    k = band.copy()
                    for column in m.reshape(p.bands, p.rows).T:
                        k = mixed(k + column)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(k.view(np.int64))
                    signatures.append(_packed(m, p.bits))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "keys", "signature"])
    return run


def _setter(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                sets = [shingle_set(t or b"", p.shingle).tobytes()
                        for t in rows.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])
    return run


def equal_minima(a: np.ndarray, b: np.ndarray, p: MinHash) -> np.ndarray:
    """Bit counts of packed signatures (uint8 rows): how many minima agree in all kept bits, for
    every row of ``a`` with every row of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    wide = [np.unpackbits(x, axis=1)[:, :p.minima * p.bits].reshape(len(x), p.minima, p.bits) for x in (a, b)]
    codes = [(x << np.arange(p.bits, dtype=np.uint8)).sum(2, dtype=np.uint8) for x in wide]
    for value in range(1 << p.bits):  # 0/1 rows of one value each: a product counts agreements
        one, two = ((c == value).astype(np.float32) for c in codes)
        out += (one @ two.T).astype(np.int32)
    return out


def _linked(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (size_a + size_b - inter)


def _confirmer(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs with both signatures and sets: the links among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two, sa, sb in zip(*(batch.column(c).to_pylist() for c in
                                          ("set_a", "set_b", "sig_a", "sig_b")), strict=True):
                codes = np.unpackbits(np.frombuffer(sa, np.uint8) ^ np.frombuffer(sb, np.uint8))
                equal = (codes[:p.minima * p.bits].reshape(p.minima, p.bits).sum(1) == 0).sum()
                if equal < p.least_equal():
                    keep.append(False)
                    continue
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(_linked(inter, len(x), len(y), p.percent)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 1 << 13) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 rows over parts of the vocabulary."""
    words, index = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(words), columns):
        first, last = np.searchsorted(index, (at, at + columns))
        ones = np.zeros((len(a) + len(b), columns), np.float32)
        ones[row[first:last], index[first:last] - at] = 1
        out += ones[:len(a)] @ ones[len(a):].T
    return out.astype(np.int64)


def _forest(pairs: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join components not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, first = np.unique(np.stack([of_a[pairs[:, 0]], of_b[pairs[:, 1]]], 1), axis=0, return_index=True)
    kept = []
    for i, j in pairs[first].tolist():
        x, y = root(int(of_a[i])), root(int(of_b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def _block_linker(p: MinHash) -> Callable[[pa.Table], pa.Table]:
    """Links between members of different components of one block (side 0 against side 1; a block
    of side 1 alone against itself)."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8)\
            .reshape(len(node), -1)
        b = np.flatnonzero(side == 1)
        a = np.flatnonzero(side == 0)
        a = a if len(a) else b
        may = (equal_minima(signature[a], signature[b], p) >= p.least_equal()) & \
            (component[a][:, None] != component[b][None, :])
        a, b, may = a[may.any(1)], b[may.any(0)], may[may.any(1)][:, may.any(0)]
        found: list[tuple[int, int]] = []
        if may.size:
            inter = _intersections([sets[i] for i in a], [sets[i] for i in b])
            sizes = np.array([len(x) for x in sets])
            links = np.argwhere(may & _linked(inter, sizes[a][:, None], sizes[b][None, :], p.percent))
            found = [(int(node[a[i]]), int(node[b[j]])) for i, j in _forest(links, component[a], component[b])]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})
    return run


def _pair_links(pairs: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"), F.col("signature").alias("sig_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"), F.col("signature").alias("sig_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(tidied(_confirmer(p)), "a long, b long")


def near_duplicates(documents: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked with it, directly or through others)
    and kept (doc_id = component_id, or null doc_id) of every row of doc_id, text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(docs.mapInArrow(
        tidied(_sketcher(p)), "doc_id long, n_shingles long, digest binary, keys array<long>, signature binary"), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    nodes_of = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = cut_lineage(known.join(nodes_of.withColumn("doc_id", F.col("node")), ["digest", "doc_id"])
                        .dropDuplicates(["digest"]).select("node", "n_shingles", "digest", "keys", "signature"))

    spread = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))\
        .withColumn("rank", F.xxhash64("node"))
    hubs = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("rank").alias("rank"),
                                     F.sum("n_shingles").alias("weight")).filter("n > 1")
    members = cut_lineage(spread.join(hubs.withColumnRenamed("rank", "first"), "key"))
    hub = members.filter("rank = first").select("key", F.col("node").alias("a")).dropDuplicates(["key"])
    pairs = cut_lineage(members.select("key", F.col("node").alias("b")).join(hub, "key").filter("a <> b")
                        .select("a", "b").distinct())

    involved = members.select(F.col("node").alias("doc_id")).distinct()
    texts = joined_ids(docs, involved, "doc_id").distinct()
    sets = texts.mapInArrow(tidied(_setter(p)), "node long, shingles binary")\
        .join(nodes.select("node", "signature"), "node")
    sets = written(sets, "shingle-sets")
    links = cut_lineage(_pair_links(pairs, sets, p))
    first = components(links)

    links = links.unionAll(cut_lineage(_rest(members, first, sets, p)))
    found = components(links)
    least = known.join(nodes_of, "digest").select("doc_id", "digest", "node")
    of_doc = least.join(found, "node", "left")\
        .select("doc_id", F.coalesce("component", "node").alias("component_id"))\
        .groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sketches.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """The rows, with all their columns, of one document of each group: that of least doc_id, once."""
    key = "_id"
    while key in {c.lower() for c in documents.columns}:
        key += "_"
    found = cut_lineage(near_duplicates(documents, p).select(F.col("doc_id").alias(key), "kept"))
    gone = found.filter("NOT kept").select(key).distinct()
    again = found.filter(F.col("kept") & F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    rows = documents.withColumn(key, F.col("doc_id").cast("long"))
    others = gone.unionAll(again)
    if others.count() <= BROADCAST_IDS:
        others = F.broadcast(others)
    once = rows.join(others, key, "left_anti")
    repeated = joined_ids(rows, again, key).dropDuplicates([key])
    return once.unionByName(repeated).select(*documents.columns)


def _rest(members: DataFrame, found: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """Links between members of a bucket that are still in different components.

    Buckets of the same members are dealt with once. Members outside the bucket's largest
    component meet all members, in blocks of bounded size.
    """
    known = members.filter("n > 2").join(found, "node", "left")\
        .withColumn("component", F.coalesce("component", "node"))
    mixed_keys = known.groupBy("key").agg(
        F.bit_xor(F.xxhash64("node")).alias("same"), F.max("n").alias("count"),
        (F.min("component") < F.max("component")).alias("mixed"),
    ).filter("mixed").groupBy("same", "count").agg(F.min("key").alias("key")).select("key")
    left = cut_lineage(known.join(mixed_keys, "key", "left_semi"))
    per = left.groupBy("key", "component").agg(F.count("*").alias("in_component"))
    largest = per.groupBy("key").agg(F.max(F.struct("in_component", "component")).alias("top"))
    # Blocks on either side, by count and by shingles.
    blocks = F.greatest(F.ceil(F.col("n") / p.block), F.ceil(F.col("weight") / p.weight)).cast("int")
    share = (F.col("n") - F.col("top.in_component")) / F.col("n")
    tagged = left.join(largest, "key").withColumns({
        "blocks": blocks, "minor": F.col("component") != F.col("top.component"),
        "minor_blocks": F.greatest(F.lit(1), F.ceil(blocks * share)).cast("int"),
    })
    place = F.xxhash64(F.col("node"), F.lit(7))
    all_side = tagged.select(
        "key", "node", "component", F.lit(1).alias("side"), F.pmod(place, F.col("blocks")).cast("int").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("minor_blocks") - 1)).alias("i"))
    minor_side = tagged.filter("minor AND blocks > 1").select(
        "key", "node", "component", F.lit(0).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
        F.pmod(place, F.col("minor_blocks")).cast("int").alias("i"))
    rows = all_side.unionByName(minor_side).join(sets, "node")
    return rows.groupBy("key", "i", "j").applyInArrow(_block_linker(p), "a long, b long")
