"""Texts cut into pieces that repeat, each distinct piece worked on once.

A piece begins at a space that a character other than white space follows, so the pieces of a
text, one after the other, are the text. Cutting, finding the distinct pieces and putting the
results of a text together are array operations; only distinct new pieces are handed on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered per worker, some 80 MB at most; the frequent ones come first.
KEPT_PIECES = 400_000
KEPT_LENGTH = 40

#: First bytes of white space in UTF-8 that takes two or three bytes, with all its continuations.
_WIDE_SPACES = "\u0085                 　"
_NARROW_SPACE = np.zeros(256, bool)
_NARROW_SPACE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[c.encode()[0] for c in _WIDE_SPACES]] = True
_WIDE_CODES = np.array(sorted(int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in _WIDE_SPACES))


@dataclass
class Cut:
    """``code`` numbers the pieces of all texts in order by their place in ``distinct``; text
    ``i`` holds ``counts[i]`` of them."""
    distinct: list[str]
    code: np.ndarray
    counts: np.ndarray


def _starts_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character starts at these places of ``data``."""
    white = _NARROW_SPACE[data[at]]
    wide = np.flatnonzero(_LEADS[data[at]])
    if len(wide):
        place = at[wide]
        padded = np.append(data, np.zeros(2, np.uint8))
        first, second, third = (padded[place + i].astype(np.int64) for i in range(3))
        code = (first << 16) | (second << 8) | np.where(first == 0xC2, 0, third)
        white[wide] = np.isin(code, _WIDE_CODES)
    return white


def cut(texts: pa.Array, single: bool = False) -> Cut:
    """Cut texts (strings without nulls). With ``single``, not after another space."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - base
    buffer = texts.buffers()[2]
    if not total:
        return Cut([], np.zeros(0, np.int64), np.zeros(n, np.int64))
    data = np.frombuffer(buffer, np.uint8)[base:base + total]
    begins = offsets[:-1][np.diff(offsets) > 0]
    at = np.flatnonzero(data == 0x20)
    ends = np.zeros(total + 1, bool)
    ends[offsets] = True
    at = at[~ends[at + 1]]
    at = at[~_starts_white(data, at + 1)]
    if single and len(at):
        at = at[(at == 0) | (data[at - 1] != 0x20) | ends[at]]
    marks = np.zeros(total, bool)
    marks[at] = True
    marks[begins] = True
    starts = np.flatnonzero(marks)
    bounds = np.append(starts, total).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    return Cut(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64),
               np.diff(np.searchsorted(starts, offsets)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values; a run may be empty."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Memo:
    """The ids of pieces, found by ``encode`` once and kept for a bounded number of pieces.
    ``encode`` gives all ids of all pieces, one after the other, and how many each piece has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int | None = None):
        self._encode, self._kept = encode, KEPT_PIECES if kept is None else kept
        self._known: dict[str, int] = {}
        self._starts, self._lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._flat, self._used = np.zeros(1 << 14, np.uint32), 0

    def _append(self, array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
        size = used + len(values)
        if size > len(array):
            array = np.append(array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype))
        array[used:size] = values
        return array

    def gather(self, found: Cut) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one text after the other, and how many each text has."""
        ids, lengths = self.gather_pieces(found)
        return ids, sums(lengths, found.counts)

    def gather_pieces(self, found: Cut) -> tuple[np.ndarray, np.ndarray]:
        """The same, and how many each piece has."""
        row = np.array(list(map(self._known.get, found.distinct, repeat(-1))), np.int64)
        missing = np.flatnonzero(row < 0)
        starts, lengths, flat = self._starts[row], self._lengths[row], self._flat[:self._used]
        if len(missing):
            pieces = [found.distinct[i] for i in missing.tolist()]
            new, sizes = self._encode(pieces)
            starts[missing], lengths[missing] = self._used + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, new.astype(np.uint32)])
            self._keep(pieces, new, sizes)
        return flat[ranges(starts[found.code], lengths[found.code])], lengths[found.code]

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        row = len(self._known)
        if row >= self._kept:
            return
        short = np.flatnonzero(np.array(list(map(len, pieces))) <= KEPT_LENGTH)[:self._kept - row]
        starts, sizes = (np.cumsum(sizes) - sizes)[short], sizes[short]
        self._starts = self._append(self._starts, row, self._used + np.cumsum(sizes) - sizes)
        self._lengths = self._append(self._lengths, row, sizes)
        self._flat = self._append(self._flat, self._used, ids[ranges(starts, sizes)])
        self._used += int(sizes.sum())
        self._known.update(zip([pieces[i] for i in short.tolist()], range(row, row + len(short)), strict=True))


def with_specials(texts: pa.Array, specials: dict[str, int], flat: Callable) -> tuple[np.ndarray, np.ndarray]:
    """``flat(texts)``, the ids and counts of texts, where the strings of special tokens have an
    id of their own and cut the text into sections that do not see each other."""
    marked = np.zeros(len(texts), bool)
    for special in specials:
        marked |= np.asarray(pc.match_substring(texts, special))
    if not marked.any():
        return flat(texts)
    apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
    sections, owner, fixed = [], [], []
    for i, (text, has) in enumerate(zip(texts.to_pylist(), marked.tolist(), strict=True)):
        for part in apart.split(text) if has else [text]:
            owner.append(i)
            fixed.append(specials.get(part, -1) if has else -1)
            sections.append("" if fixed[-1] >= 0 else part)
    ids, counts = flat(pa.array(sections, pa.string()))
    owner, fixed = np.array(owner), np.array(fixed)
    # A special token is put where its empty section stands.
    at = np.cumsum(counts)[fixed >= 0]
    return (np.insert(ids, at, fixed[fixed >= 0].astype(ids.dtype)),
            np.bincount(owner, counts + (fixed >= 0), len(texts)).astype(np.int64))
