"""Token ids in files, coded by a static range asymmetric numeral system.

Documents are sorted by id over range partitions. Each partition writes segments of whole
documents; a segment holds one frequency table of its ids, shared by its blocks, the documents'
ids and lengths, an index of checkpoints (tokens before the block, byte offset, checksum) and the
blocks. Every block is coded by itself over interleaved lanes, so blocks decode in parallel and a
damaged one is found by its checksum. Segments are rows of Parquet files: any file system Spark
writes to will do, and a retried task leaves no half-written file.

Null text is empty: the end id alone. Null ids sort first. Repeated rows are written as often as
they occur, in the order of their text. An empty table writes no segment. Extra columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import slices, tidied
from riskweave.llm.tokenizing import REMEMBERED_AS, tokens

#: Frequencies sum to 2 ** PRECISION. States stay in [2 ** 31, 2 ** 63); 32 bits move at a time.
PRECISION, LOW, LANES = 20, 31, 4096
BLOCK_TOKENS, SEGMENT_TOKENS = 1 << 18, 1 << 21
_MAGIC = b"RANS1\0"
_HEAD = struct.Struct("<6sHIQIII")  # magic, lanes, documents, tokens, blocks, bytes of table, of documents
_INDEX = np.dtype([("tokens", "<u4"), ("before", "<u8"), ("offset", "<u8"), ("bytes", "<u4"), ("crc32", "<u4")])
_FILE = "part int, segment int, n_tokens long, n_docs long, payload binary"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to 2 ** PRECISION, at least 1 where a count is."""
    some = np.flatnonzero(counts)
    if not len(some):
        return np.zeros(len(counts), np.uint64)
    if len(some) >= 1 << PRECISION:
        raise ValueError("too many different ids for the precision")
    out = np.zeros(len(counts), np.uint64)
    room = (1 << PRECISION) - len(some)
    out[some] = 1 + counts[some].astype(object) * room // int(counts.sum())
    out[counts.argmax()] += np.uint64((1 << PRECISION) - int(out.sum()))
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    """States of all lanes, then the words in the order in which the decoder needs them."""
    state = np.full(LANES, 1 << LOW, np.uint64)
    f, c = freq[ids], cum[ids]
    limit = f << np.uint64(LOW - PRECISION + 32)
    words = []
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES):
        part = slice(at, min(at + LANES, len(ids)))
        x = state[:part.stop - at]
        over = x >= limit[part]
        words.append(x[over].astype(np.uint32))  # the low half
        x = np.where(over, x >> np.uint64(32), x)
        high, rest = np.divmod(x, f[part])
        state[:part.stop - at] = (high << np.uint64(PRECISION)) + rest + c[part]
    return state.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def decode_block(data: bytes, n: int, freq: np.ndarray, cum: np.ndarray, symbol: np.ndarray, lanes: int = LANES) -> np.ndarray:
    state = np.frombuffer(data, "<u8", lanes).copy()
    words = np.frombuffer(data, "<u4", offset=8 * lanes)
    out, used, mask = np.empty(n, np.uint32), 0, np.uint64((1 << PRECISION) - 1)
    for at in range(0, n, lanes):
        k = min(lanes, n - at)
        x = state[:k]
        slot = x & mask
        ids = symbol[slot]
        out[at:at + k] = ids
        x = freq[ids] * (x >> np.uint64(PRECISION)) + slot - cum[ids]
        short = np.flatnonzero(x < 1 << LOW)
        x[short] = (x[short] << np.uint64(32)) | words[used:used + len(short)]
        used += len(short)
        state[:k] = x
    return out


def _table(freq: np.ndarray) -> bytes:
    some = np.flatnonzero(freq).astype("<u4")
    return zlib.compress(np.concatenate([np.diff(some, prepend=np.uint32(0)), freq[some].astype("<u4")]).tobytes(), 6)


def _cumulative(freq: np.ndarray) -> np.ndarray:
    return (np.cumsum(freq) - freq).astype(np.uint64)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    freq = frequencies(np.bincount(ids))
    cum = _cumulative(freq)
    blocks = [ids[i:i + BLOCK_TOKENS] for i in range(0, len(ids), BLOCK_TOKENS)]
    coded = [encode_block(b, freq, cum) for b in blocks]
    index = np.zeros(len(blocks), _INDEX)
    index["tokens"] = [len(b) for b in blocks]
    index["bytes"] = [len(c) for c in coded]
    for name, size in (("before", "tokens"), ("offset", "bytes")):
        index[name] = np.cumsum(index[size].astype(np.uint64)) - index[size]
    index["crc32"] = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
    table = _table(freq)
    docs = zlib.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes()
                         + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
                         + np.array(lengths, "<u4").tobytes(), 1)
    head = _HEAD.pack(_MAGIC, LANES, len(doc_ids), len(ids), len(blocks), len(table), len(docs))
    body = head + table + docs + index.tobytes()
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(coded)


def decode_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids. Raises ValueError on a wrong checksum."""
    magic, lanes, n_docs, n_tokens, n_blocks, table_bytes, doc_bytes = _HEAD.unpack_from(payload)
    at = _HEAD.size
    end = at + table_bytes + doc_bytes + n_blocks * _INDEX.itemsize
    if magic != _MAGIC or not lanes or zlib.crc32(payload[:end]) != struct.unpack_from("<I", payload, end)[0]:
        raise ValueError("this is no segment, or its head is damaged")
    table = np.frombuffer(zlib.decompress(payload[at:at + table_bytes]), "<u4")
    some = np.cumsum(table[:len(table) // 2])
    freq = np.zeros(int(some[-1]) + 1 if len(some) else 1, np.uint64)
    freq[some] = table[len(table) // 2:]
    cum = _cumulative(freq)
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    docs = zlib.decompress(payload[at + table_bytes:at + table_bytes + doc_bytes])
    missing = np.frombuffer(docs, np.uint8, n_docs)
    doc_ids = np.frombuffer(docs, "<i8", n_docs, n_docs).tolist()
    lengths = np.frombuffer(docs, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    index = np.frombuffer(payload, _INDEX, n_blocks, at + table_bytes + doc_bytes)
    out = np.empty(n_tokens, np.uint32)
    for block in index:
        first = end + 4 + int(block["offset"])
        n, before = int(block["tokens"]), int(block["before"])
        ids = decode_block(payload[first:first + int(block["bytes"])], n, freq, cum, symbol, lanes)
        if zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
            raise ValueError(f"the block at token {before} is damaged")
        out[before:before + n] = ids
    return [None if m else d for m, d in zip(missing, doc_ids, strict=True)], lengths, out


def _encoder(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = tokens(path), TaskContext.get().partitionId()
        docs: list[int | None] = []
        sizes: list[int] = []
        coded: list[np.ndarray] = []
        total = segment = 0

        def flush() -> pa.RecordBatch:
            payload = encode_segment(docs, sizes, np.concatenate(coded))
            row = [[part], [segment], [total], [len(docs)], [payload]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)],
                ["part", "segment", "n_tokens", "n_docs", "payload"])

        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                ids, counts = known.with_end(pc.fill_null(rows.column("text"), ""), end_id)
                ends, names, before = np.cumsum(counts), rows.column("doc_id").to_pylist(), 0
                while before < len(names):
                    # Up to the first document that fills the segment.
                    base = ends[before] - counts[before]
                    upto = min(len(names), int(np.searchsorted(ends, base + SEGMENT_TOKENS - total)) + 1)
                    docs += names[before:upto]
                    sizes += counts[before:upto].tolist()
                    coded.append(ids[base:ends[upto - 1]])
                    total += int(ends[upto - 1] - base)
                    before = upto
                    if total >= SEGMENT_TOKENS:
                        yield flush()
                        docs, sizes, coded, total, segment = [], [], [], 0, segment + 1
        if docs:
            yield flush()
    return run


def write_tokens(documents: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Write the ids of every document, each with an end id, in ascending order of doc_id."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidied(_encoder(path, end_id), REMEMBERED_AS), _FILE).write.option("compression", "none").parquet(folder)


def _decoder(digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "payload")), strict=True):
                docs, lengths, ids = decode_segment(payload)
                ends = np.cumsum(lengths)
                n = len(docs)
                if digest:
                    data = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(docs, pa.int64()),
                     pa.array(ends - lengths), pa.array(lengths), last],
                    ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, or their ids_crc32."""
    files = spark.read.schema(_FILE).parquet(folder)
    last = "ids_crc32 long" if digest else "ids array<int>"
    docs = files.select("part", "segment", "payload").mapInArrow(
        tidied(_decoder(digest)), f"part int, segment int, doc_id long, within long, n_tokens long, {last}")
    # One row per segment; only those of one partition, and one row per partition, are sorted together.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))\
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))\
        .join(before, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last.split()[0])
