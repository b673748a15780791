"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once.

A byte-level tokenizer never joins what stands before a single space with the space and the
character after it, so a text may be cut before every space that a non-space follows
(``pieces.py``). The pieces repeat; each worker remembers the ids of a bounded number of them.
The ids are those of the library for the whole text.

Most new pieces are a space, letters and perhaps punctuation. Where the tokenizer is plain byte-level
BPE its pre-tokenizer makes " letters" and "punctuation" of them, so they are handed to the library's
model as such, already in the characters that stand for bytes; all others go through the whole library.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskweave.llm.common import REMEMBERED
from riskweave.llm.pieces import Memo, cut, ranges, sums, with_specials

#: Pieces encoded as one text: more or fewer take longer.
JOINED_PIECES = 50
#: Texts that the library encodes at once; its result takes some hundred bytes per token.
ENCODED_AT_ONCE = 500

_SPACED = re.compile(r" [^\s]+\Z")
#: Characters that are letters, or neither letters, digits nor white space, in every version of Unicode
#: that a tokenizer may follow.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u0513\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = "!-/:-@\\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2010-\u2027\u3001\u3002\uff0c"
_PLAIN_PIECE = rf"^ [{_LETTERS}]+[{_MARKS}]*\z"
_MARKS_RUN = re.compile(f"[{_MARKS}]+")


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level tokenizers."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return "".join([chr(b) if b in shown else chr(next(hidden)) for b in range(256)])


_BYTE_CHARACTERS = _byte_characters()


def _is_plain_bpe(settings: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE and nothing else."""
    before, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    return (settings.get("normalizer") is None and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE"
            and not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "fuse_unk", "byte_fallback")))


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after the other, and how many each list has."""
    return (np.fromiter(itertools.chain.from_iterable(lists), np.uint32),
            np.array(list(map(len, lists)), np.int64))


class Tokens:
    """``flat(texts)`` gives all ids of all texts, and how many each text has. The strings of
    special tokens get their ids, as in the library; with ``plain`` they are ordinary text."""

    def __init__(self, path: str, plain: bool = False, kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = plain
        added = self._tokenizer.get_added_tokens_decoder()
        self._specials = {} if plain else {t.content: i for i, t in added.items()}
        ids = self._encode(["\n"])[0]
        self._break = ids[0] if len(ids) else 0
        self._joins = len(ids) == 1 and (self._encode([" a\n a"])[0] == self._break).sum() == 1
        self._model = None
        if self._joins and _is_plain_bpe(json.loads(self._tokenizer.to_str())):
            from tokenizers import pre_tokenizers

            self._model = Tokenizer(self._tokenizer.model)
            self._model.pre_tokenizer = pre_tokenizers.Split(_BYTE_CHARACTERS[0x0A], "isolated")
        self.memo = Memo(self._pieces, kept)

    def _encode(self, parts: list[str], by=None) -> tuple[np.ndarray, np.ndarray]:
        found = [joined([e.ids for e in (by or self._tokenizer).encode_batch_fast(
            parts[i:i + ENCODED_AT_ONCE], add_special_tokens=False)]) for i in range(0, len(parts), ENCODED_AT_ONCE)]
        return (np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in found)]),
                np.concatenate([np.zeros(0, np.int64), *(counts for _, counts in found)]))

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, marked = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
        if self._model and pieces:
            texts = pa.array(pieces, pa.string())
            plain = np.asarray(pc.match_substring_regex(texts, _PLAIN_PIECE))
            marked = np.asarray(pc.match_substring_regex(texts, rf"[{_MARKS}]\z"))
        easy, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, lengths = self._by_model([pieces[i] for i in easy.tolist()], 1 + marked[easy])
        more, others = self._through_library([pieces[i] for i in other.tolist()])
        order = np.argsort(np.append(easy, other), kind="stable")
        length = np.append(lengths, others)
        start = np.cumsum(length) - length
        return np.append(ids, more)[ranges(start[order], length[order])], length[order]

    def _by_model(self, pieces: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces of one or two parts; a line break stands between any two parts of a run."""
        runs = ["\n".join(pieces[i:i + JOINED_PIECES]) for i in range(0, len(pieces), JOINED_PIECES)]
        ids, counts = self._encode([codecs.charmap_decode(
            _MARKS_RUN.sub(r"\n\g<0>", run).encode(), "strict", _BYTE_CHARACTERS)[0] for run in runs], self._model)
        breaks = ids == self._break
        ends = np.zeros(len(ids) + 1, bool)
        ends[np.cumsum(counts)] = True
        ends[:-1] |= breaks
        # The ids before every part's end that are no breaks.
        before = np.append(0, np.cumsum(~breaks))[np.flatnonzero(ends)][np.cumsum(parts) - 1]
        return ids[~breaks], np.diff(before, prepend=0)

    def _through_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a space and other characters go in one text, a line break between them, and
        are cut apart at its id."""
        spaced = [i for i, p in enumerate(pieces) if _SPACED.match(p)] if self._joins else []
        runs = [spaced[i:i + JOINED_PIECES] for i in range(0, len(spaced), JOINED_PIECES)]
        ids, counts = self._encode(["\n".join([pieces[i] for i in run]) for run in runs])
        breaks = ids == self._break
        sizes = np.array([len(run) for run in runs], np.int64)
        good = sums(breaks, counts) == sizes - 1
        bounds = np.concatenate([np.flatnonzero(breaks & np.repeat(good, counts)), np.cumsum(counts)[good]])
        ends = np.sort(bounds)
        # A piece begins at its run's begin or after a break.
        starts = np.sort(np.concatenate([np.flatnonzero(breaks & np.repeat(good, counts)) + 1, (np.cumsum(counts) - counts)[good]]))
        owner = np.array(spaced, np.int64)[np.repeat(good, sizes)]
        left = np.setdiff1d(np.arange(len(pieces)), owner)
        more, lengths = self._encode([pieces[i] for i in left.tolist()])
        order = np.argsort(np.append(owner, left), kind="stable")
        start = np.append(starts, len(ids) + np.cumsum(lengths) - lengths)[order]
        length = np.append(ends - starts, lengths)[order]
        return np.append(ids, more)[ranges(start, length)], length

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return with_specials(texts, self._specials, lambda part: self.memo.gather(cut(part)))

    def with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, each text followed by an end id."""
        ids, counts = self.flat(texts)
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


#: The name under which workers remember tokenizers and the pieces they met.
REMEMBERED_AS = "tokens"
_LOADED: dict[tuple[str, bool, int | None], Tokens] = {}
REMEMBERED[REMEMBERED_AS] = _LOADED


def tokens(path: str, plain: bool = False, kept: int | None = None) -> Tokens:
    """This worker's tokenizer for a file, the one it has; it remembers ``kept`` pieces at most."""
    if (path, plain, kept) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, plain, kept] = Tokens(path, plain, kept)
    return _LOADED[path, plain, kept]
