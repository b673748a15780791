"""Alignment of two tokenizers' tokens by their bytes, and how often id pairs are linked.

Both token sequences of a space and the text are made in full. Where both have a token border
before a token that begins with a space, the document is cut into windows; most are a word.
Groups and links of a window depend on its two tuples of ids alone, so each worker remembers
them per pair of tuples. Documents are then tables of linked id pairs; the pairs of all
documents are counted by Spark.

Skew: counts are summed in each task first. Pairs that make up more than one in ``FREQUENT``
of all (document, pair) rows are at most that many; their counts are broadcast. The others are
joined by a shuffle, in which none can hold more than that share of the rows.

Defined results: every row is a document of its own, also one with a repeated or null doc_id;
null and empty texts, and texts whose tokens' bytes are not the space and the text, have zeros
and an empty digest; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.bpe import Table, byte_alphabet
from riskweave.llm.common import REMEMBERED, slices, tidied
from riskweave.llm.pieces import Cut, Memo, cut, ranges, sums
from riskweave.llm.tokenizing import Tokens, joined
from riskweave.session import written

#: Most frequent pairs whose counts are broadcast: 100,000 rows of three columns, a few MB.
FREQUENT = 100_000
#: Windows remembered per worker, about 50 MB at most; the frequent ones come first.
KEPT_WINDOWS = 100_000
#: Bytes of text aligned at once; the arrays of their links take some 50 times as much.
ALIGNED_AT_ONCE = 1 << 20
#: Between the two tuples of ids in a window's key; no id.
_BETWEEN = b"\xff\xff\xff\xff"
_MARK = "▁"
_LINKED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<long>")


@dataclass
class _Windows:
    """Per window: groups, links and its shown groups; all linked pairs, window by window."""
    groups: np.ndarray
    links: np.ndarray
    shown: list[bytes]
    pairs: np.ndarray

    def followed_by(self, other: _Windows) -> _Windows:
        return _Windows(np.append(self.groups, other.groups), np.append(self.links, other.links),
                        self.shown + other.shown, np.append(self.pairs, other.pairs))

    def first(self, n: int) -> _Windows:
        return _Windows(self.groups[:n], self.links[:n], self.shown[:n], self.pairs[:int(self.links[:n].sum())])


class Alignment:
    """Two tokenizers and the windows met so far."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Tokens(path_a, plain=True)
        self._b = SentencePieceProcessor(model_file=path_b)
        self._memo_b = Memo(self._encode_b)
        byte_of = byte_alphabet()
        names = {i: t for t, i in self.a._tokenizer.get_vocab().items()}
        special = self.a._tokenizer.get_added_tokens_decoder()
        self._bytes_a = Table([names[i].encode() if i in special else bytes(byte_of[c] for c in names[i])
                               if i in names else b"" for i in range(max(names) + 1)])
        self._bytes_b = Table([self._piece_bytes(i) for i in range(len(self._b))])
        self._spaced_a, self._spaced_b = (
            np.array([t.data[s] == 0x20 if n else False for s, n in zip(t.start, t.length, strict=True)])
            for t in (self._bytes_a, self._bytes_b))
        # No piece joins a space with a character before it, so a text may be cut there.
        inner = any(_MARK in self._b.id_to_piece(i).lstrip(_MARK) for i in range(len(self._b)))
        self._apart = not inner and self._b.encode("a  b \n", out_type=str)[0] == _MARK + "a"
        self._decimals = Table([f"{i}{mark}".encode() for i in range(max(max(names) + 1, len(self._b))) for mark in ",|;"])
        self._numbers: dict[bytes, int] = {}
        none = np.zeros(0, np.int64)
        self._known = _Windows(none, none, [], none)

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(_MARK, " ").encode()

    def _encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model puts a space before every text itself."""
        return joined(self._b.encode([p[1:] for p in pieces], num_threads=1))

    def _work_out(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> _Windows:
        """Windows from all their ids and each one's numbers of ids: a group ends where the bytes
        so far are equally many on both sides. A window is a group's end itself."""
        end_a, end_b = np.cumsum(self._bytes_a.length[a]), np.cumsum(self._bytes_b.length[b])
        _, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        window = np.searchsorted(np.cumsum(sizes_a), last_a, "right")
        links = in_a * in_b
        group = np.repeat(np.arange(len(links)), links)
        nth = ranges(np.zeros(len(links), np.int64), links)
        left = a[(last_a - in_a + 1)[group] + nth // in_b[group]].astype(np.int64)
        right = b[(last_b - in_b + 1)[group] + nth % in_b[group]].astype(np.int64)
        # Shown: a group's first ids, a bar, its second ids, a semicolon.
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        which = np.concatenate([2 * np.repeat(np.arange(len(in_a)), in_a), 2 * np.repeat(np.arange(len(in_b)), in_b) + 1])
        shown = np.concatenate([3 * a.astype(np.int64) + mark_a, 3 * b.astype(np.int64) + mark_b])[np.argsort(which, kind="stable")]
        data = self._decimals.joined(shown)
        ends = np.append(0, np.cumsum(self._decimals.length[shown]))[np.append(0, np.cumsum(sizes_a + sizes_b))].tolist()
        return _Windows(np.bincount(window, minlength=len(sizes_a)),
                        np.bincount(window, links, minlength=len(sizes_a)).astype(np.int64),
                        [data[i:j] for i, j in zip(ends, ends[1:], strict=False)], left << 32 | right)

    def _aligned(self, ids_a: np.ndarray, ids_b: np.ndarray, from_a: np.ndarray, to_a: np.ndarray,
                 from_b: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, _Windows]:
        """The number of each window among all returned ones: those known and the new ones."""
        known, bytes_a, bytes_b = self._numbers, ids_a.tobytes(), ids_b.tobytes()
        keys = [bytes_a[i:j] + _BETWEEN + bytes_b[k:m] for i, j, k, m in zip(
            *((4 * x).tolist() for x in (from_a, to_a, from_b, to_b)), strict=True)]
        number = np.array(list(map(known.get, keys, itertools.repeat(-1))), np.int64)
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number, self._known
        sizes_a, sizes_b = (to_a - from_a)[new], (to_b - from_b)[new]
        made = self._work_out(ids_a[ranges(from_a[new], sizes_a)], ids_b[ranges(from_b[new], sizes_b)], sizes_a, sizes_b)
        stored = len(self._known.groups)
        number[new] = stored + np.arange(len(new))
        every = self._known.followed_by(made)
        room = max(0, KEPT_WINDOWS - stored)
        if room:
            # Kept in the order in which they came, without gaps, as far as there is room.
            self._known = self._known.followed_by(made.first(room))
            known.update((keys[i], int(number[i])) for i in new[:room].tolist())
        return number, every

    def _tokens(self, texts: pa.Array) -> tuple[Cut, tuple, tuple]:
        found = cut(texts, single=True) if self._apart else None
        if found is None:
            whole = texts.to_pylist()
            found = Cut([t for t in whole if t], np.arange(sum(map(bool, whole))), np.array([int(bool(t)) for t in whole]))
        return found, self.a.memo.gather_pieces(found), self._memo_b.gather_pieces(found)

    def _verified(self, texts: pa.Array, found: Cut, a: tuple, b: tuple) -> np.ndarray:
        """Whether both tokenizers' bytes are those of the text."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = b"".join(t.encode() for t in texts.to_pylist())
        good = np.ones(len(sizes), bool)
        for table, (ids, lengths) in ((self._bytes_a, a), (self._bytes_b, b)):
            data_of, made = table.joined(ids), sums(table.length[ids], sums(lengths, found.counts))
            if len(made) and data_of == data and (made == sizes).all():
                continue
            ends, at = np.cumsum(made), np.cumsum(sizes)
            good &= np.array([data_of[e - m:e] == data[p - s:p] for e, m, p, s in zip(
                ends.tolist(), made.tolist(), at.tolist(), sizes.tolist(), strict=True)], bool)
        return good

    def align(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """Columns of every text, a string or null."""
        n = len(texts)
        filled = pc.fill_null(texts, "")
        spaced = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(" ", filled, ""))
        found, a, b = self._tokens(spaced)
        good = self._verified(spaced, found, a, b)
        if not good.all():
            spaced = pc.if_else(pa.array(good), spaced, "")
            found, a, b = self._tokens(spaced)
        (ids_a, lengths_a), (ids_b, lengths_b) = a, b
        n_a, n_b = sums(lengths_a, found.counts), sums(lengths_b, found.counts)
        end_a, end_b = np.cumsum(self._bytes_a.length[ids_a]), np.cumsum(self._bytes_b.length[ids_b])
        at_a = np.flatnonzero(self._spaced_a[ids_a])
        at_b = np.flatnonzero(self._spaced_b[ids_b])
        begin_a = (end_a - self._bytes_a.length[ids_a])[at_a]
        begin_b = (end_b - self._bytes_b.length[ids_b])[at_b]
        # Every text begins with a space, so its begin is a border of this kind as well.
        _, one, other = np.intersect1d(begin_a, begin_b, assume_unique=True, return_indices=True)
        at_a, at_b = at_a[one], at_b[other]
        # A window that is a whole piece is looked up once for all places of the piece.
        piece = np.searchsorted(np.cumsum(lengths_a), at_a, "right")
        alone = (np.bincount(piece, minlength=len(found.code)) == 1)[piece]
        label = np.where(alone, found.code[piece], len(found.distinct) + np.arange(len(piece)))
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        bounds_a, bounds_b = np.append(at_a, len(ids_a)), np.append(at_b, len(ids_b))
        number, windows = self._aligned(ids_a, ids_b, bounds_a[first], bounds_a[first + 1], bounds_b[first], bounds_b[first + 1])
        place = number[place]
        bounds = np.searchsorted(at_a, np.append(0, np.cumsum(n_a)))
        counts = np.diff(bounds)
        groups, links = windows.groups, windows.links
        starts = np.cumsum(links) - links
        # (document, pair) of every link, counted.
        per_doc = sums(links[place], counts)
        row = np.repeat(np.arange(n), per_doc)
        linked = windows.pairs[ranges(starts[place], links[place])]
        order = np.lexsort((linked, row))
        row, linked = row[order], linked[order]
        new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(linked) != 0))[:len(row)])
        times = np.diff(np.append(new, len(row)))
        row, pair = row[new], linked[new]
        lists = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        shown = list(map(windows.shown.__getitem__, place.tolist()))
        ends = bounds.tolist()
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": sums(groups[place], counts), "n_links": per_doc,
            "groups_sha256": [hashlib.sha256(b"".join(shown[i:j])[:-1]).hexdigest() if j > i else ""
                              for i, j in zip(ends, ends[1:], strict=False)],
            "pairs": pa.ListArray.from_arrays(lists, pa.array(pair)),
            "times": pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64)))}


REMEMBERED_AS = "alignment"
_LOADED: dict[tuple[str, str], Alignment] = {}
REMEMBERED[REMEMBERED_AS] = _LOADED


def _alignment(path_a: str, path_b: str) -> Alignment:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Alignment(path_a, path_b)
    return _LOADED[path_a, path_b]


def linked(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row: numbers of tokens, groups and links, the groups' digest, the linked id pairs (the
    first tokenizer's id times 2 ** 32 plus the second's) and how often each is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _alignment(path_a, path_b)
        for batch in batches:
            for rows in slices(batch, "text", ALIGNED_AT_ONCE):
                found = both.align(rows.column("text"))
                columns = [x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", *found])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(run, REMEMBERED_AS), _LINKED)


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair, docs (how many documents hold it linked) and best (whether no pair of its first id
    is in more) of ``linked`` documents."""
    counts = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    first = F.shiftright("pair", 32)
    top = counts.groupBy(first.alias("_first")).agg(F.max("docs").alias("_top"))
    return counts.withColumn("_first", first).join(top, "_first")\
        .select("pair", "docs", (F.col("docs") == F.col("_top")).alias("best"))


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every row's numbers, n_best and count_sum, and the digest of its groups."""
    docs = written(linked(documents, path_a, path_b).withColumn("_row", F.monotonically_increasing_id()), "linked")
    counts = written(pair_counts(docs), "pair-counts")
    least = counts.agg(F.coalesce(F.expr(f"sum(docs) div {FREQUENT}"), F.lit(0))).first()[0] + 1
    pairs = docs.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_p"))\
        .select("_row", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("_times"))
    frequent, rare = counts.filter(F.col("docs") >= least), counts.filter(F.col("docs") < least)
    rated = pairs.join(F.broadcast(frequent), "pair", "left")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"),
            F.sum(F.col("_times") * F.col("docs")).alias("_sum"))

    many = summed(rated.filter(F.col("docs").isNotNull()))
    few = summed(rated.filter(F.col("docs").isNull()).select("_row", "pair", "_times").join(rare, "pair"))
    both = many.unionAll(few).groupBy("_row").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return docs.join(both, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
