"""Ranked lexical search: per item, documents grouped by the mask of the terms they hold.

Documents become blocks: per block, each term's postings (document, occurrences), written once.
A block meets the items in groups of bounded size. For an item, its terms' postings set one bit
per term in a mask per document; documents with equal masks form a group. A mask's score is at
most the sum of its terms' highest parts in the block. Masks are evaluated by descending bound,
some at a time, until the next bound is below the k-th score found: no document of the rest can
be among the k best. A block gives at most k documents per item; Spark cuts them to k.

Blocks hold the postings of the items' terms only, if those terms stay within a checked size,
else of all terms; the result is the same. Scores are whole numbers, so it does not depend on
how documents are dealt.

Defined results: a null or termless text is never found; a null doc_id is found like any other
and comes last among equal scores; repeated rows are documents of their own; rows of one item_id
(null is one as well) are one item with the terms of all; an item without terms, or whose terms no
document holds, has no rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import slices, tidied
from riskweave.llm.pieces import ranges
from riskweave.session import written

#: Bytes of terms that are sent to all tasks at most, and of items that are broadcast.
SENT_TERMS, BROADCAST_ITEMS = 8 << 20, 32 << 20
#: Items that meet a block at once, in bytes of their terms; documents and postings of a block.
GROUP_BYTES, BLOCK_DOCS, BLOCK_POSTINGS = 2 << 20, 1 << 15, 1 << 20
#: Parts over which blocks are spread where items are not broadcast.
SALTS = 64
FIRST_MASKS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = ("docs binary, missing binary, sizes binary, terms array<string>, df array<long>, "
          "posted binary, times binary, n_docs long, n_terms long")
_PLAIN = bytes(ord(chr(b).lower()) if chr(b) in _UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: Column) -> Column:
    """All terms of a text in order, A to Z in lower case; null has none."""
    lowered = F.translate(text, _UPPER, _LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)),
                      F.array().cast("array<string>"))


class _Block:
    """Documents and their postings, gathered until the block is full."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.missing: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]] = []  # terms, code, document, times
        self.n, self.postings, self.counted, self.total = 0, 0, 0, 0

    def row(self) -> pa.RecordBatch:
        names: dict[str, int] = {}
        code = [np.array([names.setdefault(t, len(names)) for t in part[0]], np.int64)[part[1]] for part in self.parts]
        empty = np.zeros(0, np.int64)
        code = np.concatenate([empty, *code])
        doc = np.concatenate([empty, *(part[2] for part in self.parts)])
        times = np.concatenate([empty, *(part[3] for part in self.parts)])
        order = np.lexsort((doc, code))
        df = np.bincount(code, minlength=len(names))
        values = [np.concatenate([empty, *self.docs]).astype("<i8").tobytes(),
                  np.concatenate([empty, *self.missing]).astype(np.uint8).tobytes(),
                  np.concatenate([empty, *self.sizes]).astype("<i8").tobytes(), list(names), df.tolist(),
                  doc[order].astype("<u4").tobytes(), times[order].astype("<u4").tobytes(), self.counted, self.total]
        kinds = [pa.binary()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int64())] + [pa.binary()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                          [c.split()[0] for c in _BLOCK.split(", ")])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts (strings without nulls), and the number of each one's text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if texts.buffers()[2] else b""
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int64)),
                                             pa.py_buffer(data.translate(_PLAIN)))
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    some = np.asarray(pc.binary_length(words)) > 0
    return (words, text) if some.all() else (words.filter(pa.array(some)), text[some])


def _block_maker(wanted: list[str] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if wanted is None else pa.array(wanted, pa.large_string())
        block = _Block()
        for batch in batches:
            for rows in slices(batch, "text"):
                words, text = _words(pc.fill_null(rows.column("text"), ""))
                n = np.bincount(text, minlength=rows.num_rows)
                block.counted += int((n > 0).sum())
                block.total += len(words)
                if asked is None:
                    coded = words.dictionary_encode()
                    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                else:
                    code = pc.fill_null(pc.index_in(words, value_set=asked), -1).to_numpy().astype(np.int64)
                    text, code = text[code >= 0], code[code >= 0]
                    met, code = np.unique(code, return_inverse=True)
                    names = [wanted[i] for i in met.tolist()]
                # Only documents that hold a term are kept; they are numbered on.
                found, doc = np.unique(text, return_inverse=True)
                key, times = np.unique(doc * max(1, len(names)) + code, return_counts=True)
                ids = rows.column("doc_id").take(pa.array(found))
                block.docs.append(pc.fill_null(ids, 0).to_numpy())
                block.missing.append(np.asarray(ids.is_null()).astype(np.int64))
                block.sizes.append(n[found])
                block.parts.append((names, key % max(1, len(names)), block.n + key // max(1, len(names)), times))
                block.n += len(found)
                block.postings += len(key)
                if block.n >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.counted:
            yield block.row()
    return run


def _best(count: int, total: int, k: int) -> Callable:
    """The k best documents of a block for every item of a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                docs = np.frombuffer(one["docs"].as_buffer(), "<i8")
                missing = np.frombuffer(one["missing"].as_buffer(), np.uint8)
                sizes = np.frombuffer(one["sizes"].as_buffer(), "<i8")
                posted = np.frombuffer(one["posted"].as_buffer(), "<u4").astype(np.int64)
                times = np.frombuffer(one["times"].as_buffer(), "<u4").astype(np.int64)
                place = {t: i for i, t in enumerate(one["terms"].as_py())}
                df = np.array(one["df"].as_py(), np.int64)
                starts = np.cumsum(df) - df
                m = 100 - 90 + (90 * sizes * count) // total
                part = (1_000_000_000 * times) // (1000 * times + 8 * m[posted])
                top = np.maximum.reduceat(part, starts) if len(df) else df
                after = np.lexsort((docs, missing))  # documents by id, nulls last
                rank = np.empty(len(docs), np.int64)
                rank[after] = np.arange(len(docs))
                items, found, scores = [], [], []
                for item in one["items"].as_py():
                    here = [(place[t], w) for t, w in zip(item["terms"], item["weights"], strict=True) if w and t in place]
                    if here:
                        doc, score = best_documents(here, starts, df, posted, part, top, rank, k)
                        items += [item["item_id"]] * len(doc)
                        found.append(doc)
                        scores.append(score)
                doc = np.concatenate([np.zeros(0, np.int64), *found])
                ids = pa.array(docs[doc], pa.int64(), mask=missing[doc].astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()), ids, pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))],
                    ["item_id", "doc_id", "score"])
    return run


def best_documents(here: list[tuple[int, int]], starts: np.ndarray, df: np.ndarray, posted: np.ndarray,
                   part: np.ndarray, top: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best (score above 0) for terms and weights ``here``."""
    most = np.array([w * top[t] for t, w in here], np.int64)
    width = -(-len(here) // 64)
    masks = np.zeros((width, len(rank)), np.uint64)
    for bit, (t, _) in enumerate(here):
        masks[bit // 64, posted[starts[t]:starts[t] + df[t]]] |= np.uint64(1 << bit % 64)
    held = np.flatnonzero(masks.any(0))
    if width == 1:
        mask, group = np.unique(masks[0, held], return_inverse=True)
        mask = mask[None]
    else:
        mask, group = np.unique(masks[:, held], axis=1, return_inverse=True)
    bound = np.zeros(mask.shape[1], np.int64)
    for bit in range(len(here)):
        bound += (mask[bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) * most[bit]
    order = np.argsort(-bound, kind="stable")
    members = held[np.argsort(group.ravel(), kind="stable")]
    size = np.bincount(group.ravel(), minlength=len(bound))
    first = np.cumsum(size) - size
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, FIRST_MASKS
    while done < len(order):
        if len(scores) == k and bound[order[done]] < scores[-1]:
            break
        some = order[done:done + step]
        if len(scores) == k:
            some = some[bound[some] >= scores[-1]]
        new = np.sort(members[ranges(first[some], size[some])])
        score = np.zeros(len(new), np.int64)
        for t, w in here:
            mine = posted[starts[t]:starts[t] + df[t]]
            at = np.minimum(np.searchsorted(mine, new), len(mine) - 1)
            score += np.where(mine[at] == new, w * part[starts[t] + at], 0)
        docs, scores = np.append(docs, new[score > 0]), np.append(scores, score[score > 0])
        keep = np.lexsort((rank[docs], -scores))[:k]
        docs, scores = docs[keep], scores[keep]
        done, step = done + step, 2 * step
    return docs, scores


def search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of every item's k highest-scoring documents."""
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"),
                                 F.explode(terms(F.col("text").cast("string"))).alias("term")).distinct(), "item-terms")
    distinct = asked.select("term").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    wanted = [r[0] for r in distinct.collect()] if size <= SENT_TERMS else None
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = written(docs.mapInArrow(tidied(_block_maker(wanted)), _BLOCK), "posting-blocks")
    count, total = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_terms")]).first()
    df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("_t")).groupBy(F.col("_t.terms").alias("term"))\
        .agg(F.sum("_t.df").alias("_df"))
    weight = F.floor(1000 * F.log((2 * F.lit(count) + 2).cast("double") / (2 * F.col("_df") + 1))).cast("long")
    weighted = asked.join(df, "term").select("item_id", "term", weight.alias("weight"), (F.octet_length("term") + 64).alias("_size"))
    # One item is as long as its text; items are dealt into groups of bounded size.
    weighed = written(weighted, "weighted-terms")
    whole = weighed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    groups = max(1, -(-whole // GROUP_BYTES))
    per_item = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_t"))
    grouped = per_item.select(
        F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group"),
        F.struct("item_id", F.col("_t.term").alias("terms"), F.col("_t.weight").alias("weights")).alias("item"))\
        .groupBy("group").agg(F.collect_list("item").alias("items"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    copies = blocks.drop("n_docs", "n_terms").withColumn("group", every)
    if whole <= BROADCAST_ITEMS:
        met = copies.join(F.broadcast(grouped), "group")
    else:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        met = copies.withColumn("salt", F.pmod(F.xxhash64("docs", "posted"), F.lit(SALTS)))\
            .join(grouped.withColumn("salt", salt), ["group", "salt"]).drop("salt")
    found = met.drop("group").mapInArrow(tidied(_best(count, max(1, total), k)), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)\
        .select("item_id", "rank", "doc_id", "score")
