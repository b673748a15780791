"""Byte-level BPE by speculation: propose the longest matches, check all neighbours, mend the rest.

A sequence of tokens is what merging gives if each token alone is (that is, merging its bytes
gives it back) and no merge would have joined two neighbours across their border before both
were complete. Both are facts about a token or a pair, so the greedy longest matches of many
words are checked at once with arrays: a pair is taken apart from its latest merge on, and at
every step the two pieces at the border are looked up among the merges. Only words with a
failing pair are merged step by step.

Texts are cut into pieces (``pieces.py``); distinct new pieces are cut into words by the
tokenizer file's own pre-tokenizer. Special tokens' strings get their ids, as in the library.

Defined results: a null text is an empty one and has no ids; rows are kept one by one, also
repeated ones, in no order, with a null doc_id as it is; an empty table gives an empty table;
columns other than doc_id and text (or ids) are not looked at. Ids that the file does not
hold cannot be decoded and raise an error; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import REMEMBERED, slices, tidied
from riskweave.llm.pieces import Memo, cut, ranges, sums, with_specials

_NEVER = np.iinfo(np.int64).max
_NO_MERGE = (_NEVER, -1)
#: Symbols up to which a word is merged by looking through all its pairs, not with a heap.
SHORT = 24
#: Bytes up to which words are proposed for together, step by step.
AT_ONCE = 64
#: Pieces that every version of Unicode makes one word: Latin letters, perhaps after a space.
_ONE_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+\Z")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: visible Latin-1 characters stand for themselves, the others for
    characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


class Table:
    """Byte strings by number in one array; ``joined`` puts many together."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.data[ranges(self.start[numbers], self.length[numbers])].tobytes()


class Merges:
    """Merges in order of rank, each of two known tokens into a new one."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, n_ids: int):
        self.n = n_ids
        self.rank = np.full(n_ids, -1, np.int64)
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int64)
        self.left[made], self.right[made] = left, right
        keys = left * n_ids + right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        self.pairs = dict(zip(zip(left.tolist(), right.tolist(), strict=True), enumerate(made.tolist()), strict=True))
        alone = self.compatible(left, right, np.arange(len(made)))
        self.whole = np.ones(n_ids, bool)
        while True:
            now = alone & self.whole[left] & self.whole[right]
            if (self.whole[made] == now).all():
                break
            self.whole[made] = now

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves a border between each ``a`` and the ``b`` after it; with
        ``limit``, up to the merge of that rank."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER) if limit is None else limit.astype(np.int64)
        while len(open_):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            crossing = (self._keys[at] == key) & (self._order[at] < limit)
            good[open_[crossing]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            # Of two equal pairs the left one is merged first.
            second = rank_b >= rank_a
            limit = np.where(second, rank_b + 1, rank_a)
            go_on = ~crossing & (np.maximum(rank_a, rank_b) >= 0)
            a, b = np.where(second, a, self.right[a])[go_on], np.where(second, self.left[b], b)[go_on]
            open_, limit = open_[go_on], limit[go_on]
        return good

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the merge of lowest rank, the leftmost of equal ones."""
        if len(symbols) <= SHORT:
            found = [self.pairs.get(p, _NO_MERGE) for p in zip(symbols, symbols[1:], strict=False)]
            while found and (best := min(found)) is not _NO_MERGE:
                i = found.index(best)
                symbols[i:i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = self.pairs.get((symbols[i - 1], symbols[i]), _NO_MERGE)
                if i < len(found):
                    found[i] = self.pairs.get((symbols[i], symbols[i + 1]), _NO_MERGE)
            return symbols
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != x or j >= n or symbols[j] != y:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]


class Prefixes:
    """The longest token at places of a byte string, for tokens of up to 8 bytes: a hash table
    of (bytes, length), looked up for many places at once."""

    SLOTS = 1 << 19
    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
    BELOW = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)

    def __init__(self, tokens: dict[bytes, int]):
        short = [(int.from_bytes(t, "little"), len(t), i) for t, i in tokens.items() if len(t) <= 8]
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.length, self.id = np.zeros(self.SLOTS, np.int8), np.full(self.SLOTS, -1, np.int64)
        key, length, ids = (np.array(c, kind) for c, kind in zip(zip(*short, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        slot = self._slot(key, length)
        while len(key):
            free = np.flatnonzero(self.id[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[free]], self.length[slot[free]], self.id[slot[free]] = key[free], length[free], ids[free]
            left = np.ones(len(key), bool)
            left[free] = False
            key, length, ids, slot = key[left], length[left], ids[left], (slot[left] + 1) % self.SLOTS
        longer = {int.from_bytes(t[:8], "little") for t in tokens if len(t) > 8}
        self.longer = np.array(sorted(longer), np.uint64)
        self.reach = np.ones(1 << 16, np.int64)  # longest short token by its first two bytes
        for t in tokens:
            if 1 < len(t):
                at = t[0] | t[1] << 8
                self.reach[at] = max(self.reach[at], min(len(t), 8))

    def _slot(self, key: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (((key + np.asarray(length, np.uint64)) * self.MULTIPLIER) >> np.uint64(45)).astype(np.int64)

    def find(self, key: np.ndarray, length: int) -> np.ndarray:
        """Token of these ``length`` bytes, -1 where there is none."""
        out, open_ = np.full(len(key), -1, np.int64), np.arange(len(key))
        slot = self._slot(key, length)
        while len(open_):
            there = self.id[slot]
            hit = (there >= 0) & (self.key[slot] == key) & (self.length[slot] == length)
            out[open_[hit]] = there[hit]
            on = (there >= 0) & ~hit
            open_, key, slot = open_[on], key[on], (slot[on] + 1) % self.SLOTS
        return out


class Coder:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, kinds = spec["model"], [spec["pre_tokenizer"]["type"], spec["decoder"]["type"], spec["model"]["type"]]
        if kinds != ["ByteLevel", "ByteLevel", "BPE"] or spec["normalizer"] or model.get("dropout"):
            raise ValueError("only files of byte-level BPE are read")
        vocabulary = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        n = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.merges = Merges(left, right, made, n)
        byte_of = byte_alphabet()
        strings = [b""] * n
        for token, i in vocabulary.items():
            strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            strings[i] = token.encode()
        self.bytes = Table(strings)
        self._known = np.array([bool(s) for s in strings])
        self.decimals = Table([f"{i},".encode() for i in range(n)])
        whole = {strings[i]: i for i in vocabulary.values() if self.merges.whole[i]}
        self._vocabulary, self._prefixes = whole, Prefixes(whole)
        self._single = np.array([vocabulary[c] for c in sorted(byte_of, key=byte_of.get)], np.int64)
        self._longest = max(map(len, whole))
        self._to_latin = str.maketrans({c: chr(b) for c, b in byte_of.items()})
        self._words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._memo = Memo(self.encode_pieces)

    def words_of(self, piece: str) -> list[bytes]:
        """The file's words of a piece, in bytes."""
        if _ONE_WORD.match(piece):
            return [piece.encode()]
        return [w.translate(self._to_latin).encode("latin-1") for w, _ in self._words(piece)]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches, one after the other."""
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self._longest)
            while (found := self._vocabulary.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for all words: all tokens in order, and the number of each one's word."""
        whole = list(map(self._vocabulary.get, words))
        rest = [i for i, found in enumerate(whole) if found is None]
        done = [i for i, found in enumerate(whole) if found is not None]
        owners, tokens, steps = [np.array(done, np.int64)], [np.array([whole[i] for i in done], np.int64)], [np.zeros(len(done), np.int64)]
        by_hand = [i for i in rest if len(words[i]) > AT_ONCE]
        word = np.array([i for i in rest if len(words[i]) <= AT_ONCE], np.int64)
        data = np.frombuffer(b"".join([words[i] for i in word.tolist()]) + bytes(8), np.uint8)
        eight = np.zeros(len(data) - 8, np.uint64)
        for i in range(8):
            eight |= data[i:i + len(eight)].astype(np.uint64) << np.uint64(8 * i)
        size = np.array([len(words[i]) for i in word.tolist()], np.int64)
        end = np.cumsum(size)
        at, step = end - size, 0
        while len(word):
            key, left = eight[at], end - at
            long = (left > 8) & np.isin(key, self._prefixes.longer)
            if long.any():
                by_hand += word[long].tolist()
                word, at, end, key, left = (x[~long] for x in (word, at, end, key, left))
            reach = np.minimum(left, self._prefixes.reach[(key & np.uint64(0xFFFF)).astype(np.int64)])
            found, length = self._single[(key & np.uint64(0xFF)).astype(np.int64)], np.ones(len(word), np.int64)
            open_ = np.flatnonzero(reach > 1)
            for n in range(8, 1, -1):
                tried = open_[reach[open_] >= n]
                token = self._prefixes.find(key[tried] & self._prefixes.BELOW[n], n)
                hit = token >= 0
                found[tried[hit]], length[tried[hit]], reach[tried[hit]] = token[hit], n, 0
            owners.append(word)
            tokens.append(found)
            steps.append(np.full(len(word), step))
            step += 1
            at = at + length
            on = at < end
            word, at, end = word[on], at[on], end[on]
        again = set(by_hand)
        owner, token, place = np.concatenate(owners), np.concatenate(tokens), np.concatenate(steps)
        if again:
            keep = ~np.isin(owner, by_hand)
            hand = [(i, t, k) for i in sorted(again) for k, t in enumerate(self.propose(words[i]))]
            owner, token, place = (np.append(x[keep], np.array(c, np.int64)) for x, c in zip(
                (owner, token, place), zip(*hand, strict=True), strict=True))
        order = np.lexsort((place, owner))
        return token[order], owner[order]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words, and how many each word has."""
        flat, word = self.proposals(words)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair, at = np.unique(flat[inside] * self.merges.n + flat[inside + 1], return_inverse=True)
        good = self.merges.compatible(pair // self.merges.n, pair % self.merges.n)[at]
        failing = np.unique(word[inside[~good]])
        keep = ~np.isin(word, failing)
        mended = [self.merges.merged(self._single[np.frombuffer(words[w], np.uint8)].tolist()) for w in failing.tolist()]
        flat = np.append(flat[keep], np.array([i for ids in mended for i in ids], np.int64))
        word = np.append(word[keep], np.repeat(failing, [len(ids) for ids in mended]))
        order = np.argsort(word, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        code, counts = [], []
        for piece in pieces:
            words = self.words_of(piece)
            counts.append(len(words))
            code += [number.setdefault(w, len(number)) for w in words]
        ids, lengths = self.encode_words(list(number))
        starts, code = np.cumsum(lengths) - lengths, np.array(code, np.int64)
        return ids[ranges(starts[code], lengths[code])], sums(lengths[code], np.array(counts, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        return with_specials(texts, self.specials, lambda part: self._memo.gather(cut(part)))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text in UTF-8."""
        if len(ids) and (int(ids.max()) >= self.merges.n or int(ids.min()) < 0 or not self._known[ids].all()):
            raise ValueError("an id that the tokenizer file does not hold")
        data = self.bytes.joined(ids)
        out = _parts(data, self.bytes.length[ids], counts)
        return [x.decode("utf-8", "replace").encode() for x in out]

    def listed(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        return [x[:-1] for x in _parts(self.decimals.joined(ids), self.decimals.length[ids], counts)]


def _parts(data: bytes, lengths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """``data`` cut after every ``counts`` strings of these lengths."""
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))].tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


REMEMBERED_AS = "coder"
_LOADED: dict[str, Coder] = {}
REMEMBERED[REMEMBERED_AS] = _LOADED


def coder(path: str) -> Coder:
    """This worker's coder for a file."""
    if path not in _LOADED:
        _LOADED[path] = Coder(path)
    return _LOADED[path]


def _mapped(documents: DataFrame, path: str, make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, counts = known.encode(rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *make(known, ids, counts)], names)
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.mapInArrow(tidied(run, REMEMBERED_AS), schema)


def _lists(known: Coder, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    bounds = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return [pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))]


def _digests(known: Coder, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return [pa.array(counts), pa.array([sha(x) for x in known.listed(ids, counts)], pa.string()),
            pa.array([sha(x) for x in known.decode(ids, counts)], pa.string())]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _mapped(documents, path, _lists, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row's ids; null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.diff(lists.offsets.to_numpy())
            texts = known.decode(lists.flatten().to_numpy().astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])
    rows = encoded.select("doc_id", F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(tidied(run, REMEMBERED_AS), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded."""
    docs = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _mapped(docs, path, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
