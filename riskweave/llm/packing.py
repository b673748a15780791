"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A document's ids and an end id make pieces of at most ``capacity`` tokens; only longer documents
are cut, and their first piece may be shorter. A round takes the pieces of the longest lengths
left, range-sorts them with the gaps, finds each piece's successor (the tightest gap that fits
and that no longer piece takes) by a sweep of window functions, settles which piece gets which
gap by rank, updates the gaps, writes them and repeats. Unopened sequences are the widest gaps, so
they are taken last. A sweep's rows are runs of equal lengths and of equal gaps: at most
``capacity`` lengths, some thousand runs in all, whatever the corpus. A round over one length
(``width`` 1) is best-fit decreasing itself; wider rounds are fewer and waste next to nothing more.
Ranks within a length are prefix sums over hashed parts of bounded size, so the pieces
themselves are placed in parallel and none passes through the driver.

Null text is empty (a piece of the end id alone); an empty table gives no pieces; a null doc_id
is a document like any other; repeated rows are packed as often as they occur; ties in rank are
broken by doc_id, piece and checksum; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import planned_once, slices, tidied
from riskweave.llm.pieces import ranges
from riskweave.llm.tokenizing import REMEMBERED_AS, tokens
from riskweave.session import scratch_dir, written

#: Pieces of one length that one task ranks.
RANKED_AT_ONCE = 2_000
#: Bytes of text cut into pieces at once, and words' ids that a worker remembers: both are what a worker's
#: memory goes to, beside an executor whose heap earlier stages have filled.
TEXT_AT_ONCE, REMEMBERED_WORDS = 1 << 20, 200_000
#: Lengths up to half the capacity that one round places together.
WIDTH = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"
_GAPS = "gap long, first long, n long"
_ROUND = "length long, rank long, each long, offset long, first long, n long, gap long"


def _piece_maker(path: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(path, kept=REMEMBERED_WORDS)
        for batch in batches:
            for rows in slices(batch, "text", TEXT_AT_ONCE):
                ids, counts = known.with_end(pc.fill_null(rows.column("text"), ""), end_id)
                # All pieces but a document's first are of full length.
                pieces_of = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces_of)
                piece = ranges(np.zeros(len(counts), np.int64), pieces_of)
                first = counts - (pieces_of - 1) * capacity
                begin = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = 4 * ((np.cumsum(counts) - counts)[row] + begin)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(begin),
                     pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(documents: DataFrame, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(_piece_maker(path, end_id, capacity), REMEMBERED_AS), _PIECES)


def windows(lengths: list[int], capacity: int, width: int) -> list[tuple[int, int]]:
    """Least and greatest length of each round, longest first. Lengths over half the capacity
    never share a sequence, so one round takes them all; the others go ``width`` at a time."""
    of_window: dict[int, list[int]] = {}
    for length in lengths:
        of_window.setdefault(-1 if 2 * length > capacity else (capacity // 2 - length) // width, []).append(length)
    return [(min(w), max(w)) for _, w in sorted(of_window.items())]


#: One round. A gap offers as many slots as it holds of the longest piece. From long to short, gaps
#: push slots and pieces pop the latest, which is the tightest left: the depth of that stack is a
#: prefix sum, and a slot is taken if the depth falls below it later on. As many slots are taken as
#: there are pieces, so the rank among either settles which piece gets which slot. Where a run of
#: slots meets a run of pieces, slots [x, y) are cut into the end of one sequence, whole sequences
#: and the beginning of one. A run of gaps also gives its sequences that stay as they are, in the same
#: step: a second use of a CTE is planned and run a second time, and the driver pays for each plan.
_SWEEP = """
WITH offers AS (SELECT *, greatest(gap div :top, 1) AS each FROM {gaps}),
events AS (
  SELECT gap AS size, 0 AS kind, gap, first, n, each, if(gap >= :low, n * each, 0) AS units FROM offers
  UNION ALL
  SELECT length, 1, NULL, NULL, NULL, NULL, count FROM {lengths} WHERE length BETWEEN :low AND :top),
stacked AS (
  SELECT *, sum(if(kind = 0, units, -units)) OVER (ORDER BY size DESC, kind, first
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM events),
later AS (
  SELECT *, min(depth) OVER (ORDER BY size DESC, kind, first
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM stacked),
swept AS (
  SELECT *, if(kind = 0, units - least(greatest(least - depth + units, 0), units), units) AS taken FROM later),
ranked AS (
  SELECT *, sum(if(kind = 0, taken, 0)) OVER upto AS slots, sum(if(kind = 1, taken, 0)) OVER upto AS pieces FROM swept
  WINDOW upto AS (ORDER BY size DESC, kind, first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (SELECT *, if(kind = 0, slots, pieces) AS to, if(kind = 0, slots, pieces) - taken AS from
  FROM ranked WHERE kind = 0 OR taken > 0),
met AS (
  SELECT *, lead(from) OVER (ORDER BY from, kind) AS next,
    last(if(kind = 0 AND taken > 0, struct(from, gap, first, each), NULL), true) OVER upto AS s,
    last(if(kind = 1, struct(from, to, size), NULL), true) OVER upto AS p
  FROM runs WINDOW upto AS (ORDER BY from, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
slots AS (
  SELECT gap AS own_gap, first AS own_first, n AS own_n, (taken + each - 1) div each AS opened,
    s.gap, s.first AS base, s.each, p.size AS length, from - p.from AS rank, from - s.from AS x,
    coalesce(next, p.to) - s.from AS y FROM met),
bounds AS (SELECT *, least(y, (x + each - 1) div each * each) AS a FROM slots),
cut AS (
  SELECT *, inline(array(struct(x AS lo, a AS hi, a - x AS in_one, false AS rest),
    struct(a AS lo, greatest(a, y div each * each) AS hi, each AS in_one, false AS rest),
    struct(greatest(a, y div each * each) AS lo, y AS hi, y - greatest(a, y div each * each) AS in_one, false AS rest),
    struct(opened AS lo, own_n AS hi, NULL AS in_one, true AS rest))) FROM bounds),
placed AS (
  SELECT if(rest, NULL, length) AS length, if(rest, NULL, rank + lo - x) AS rank, in_one AS each,
    if(rest, own_first + lo, base + lo div each) AS first, if(rest, hi - lo, (hi - lo) div in_one) AS n,
    if(rest, own_gap, gap) AS gap, lo, rest
  FROM cut WHERE hi > lo),
filled AS (
  SELECT *, sum(each * length) OVER (PARTITION BY first ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used,
    lead(lo) OVER (PARTITION BY first ORDER BY lo) IS NULL AS at_end FROM placed)
SELECT length, rank, each, :capacity - gap + used - each * length AS offset, first, n,
  if(rest, gap, if(at_end, gap - used, NULL)) AS gap FROM filled
"""


def sweep(gaps: DataFrame, lengths: DataFrame, low: int, top: int, capacity: int) -> DataFrame:
    """One round: all pieces of ``low`` to ``top`` ids get places in the gaps (gap, first, n: n
    sequences from the first on that have this gap).

    Rows with a length are places: pieces of that length from a rank on, ``each`` to a sequence,
    at an offset in n sequences from ``first`` on. Rows with a positive gap are the gaps after
    the round. Both come from windows over runs, not over pieces.
    """
    return gaps.sparkSession.sql(
        _SWEEP, args={"low": low, "top": top, "capacity": capacity}, gaps=gaps, lengths=lengths)


def plan(lengths: DataFrame, capacity: int, width: int = WIDTH) -> DataFrame:
    """All rounds over (length, count): length, rank, each, offset, first, n of ``sweep``. Each
    round is written, so a lost executor repeats no earlier one."""
    spark = lengths.sparkSession
    lengths = written(lengths.select(F.col("length").cast("long"), F.col("count").cast("long")), "lengths")
    # At most ``capacity`` rows.
    counts = {r[0]: r[1] for r in lengths.collect()}
    # As many sequences as pieces are enough; those that no round opens stay empty.
    gaps = spark.createDataFrame([(capacity, 0, sum(counts.values()))], _GAPS)
    folder, rounds = scratch_dir(spark, "rounds"), []
    with planned_once(spark):
        for low, top in windows(list(counts), capacity, width):
            rounds.append(f"{folder}/{low}-{top}")
            sweep(gaps, lengths, low, top, capacity).write.parquet(rounds[-1])
            gaps = spark.read.schema(_ROUND).parquet(rounds[-1]).filter("gap > 0").select("gap", "first", "n")
    if not rounds:
        return spark.createDataFrame([], _ROUND).drop("gap")
    return spark.read.schema(_ROUND).parquet(*rounds).filter("length is not null").drop("gap")


def _placer(steps: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((steps[:, 1], steps[:, 0]))
        length, lo, each, offset, first = steps[order].T
        starts = np.searchsorted(length, np.arange(length.max(initial=0) + 2))
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                mine = size == s
                a, b = starts[s], starts[s + 1]
                row[mine] = a + np.searchsorted(lo[a:b], rank[mine], side="right") - 1
            within = rank - lo[row]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(first[row] + within // each[row], pa.int64()),
                 pa.array(offset[row] + within % each[row] * size, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(documents: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, width: int = WIDTH) -> DataFrame:
    """Every piece with its sequence_id and its gapless offset there."""
    made = written(pieces(documents, path, end_id, capacity), "pieces")
    lengths = made.groupBy("length").count()
    places = plan(lengths, capacity, width)
    # Some thousand rows: each round places at most as many runs as it holds lengths and gaps.
    steps = np.array([tuple(r) for r in places.select("length", "rank", "each", "offset", "first").collect()],
                     np.int64).reshape(-1, 5)
    parts = F.broadcast(lengths.select("length", F.ceil(F.col("count") / RANKED_AT_ONCE).alias("parts")))
    tagged = made.join(parts, "length").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "parts"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tagged.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = tagged.join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.row_number().over(within) - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(steps), _PLACED)
