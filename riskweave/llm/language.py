"""Languages of mixed text: script ranges, then Viterbi over per-word scores.

A word is a run of letters of one script. Its script, by code-point ranges, leaves the languages
that write it; among them it scores the log-probabilities of its letter trigrams. Viterbi over a
document's words, with a penalty for every switch, labels spans; the language with most letters is
the document's, and its share of all letters is the score. Words of a script that no language
writes are in no span and count for no language.

Trigrams and scripts are counted over all labelled rows into hashed tables of a fixed size.

Null text, or text without a letter, is ``und`` with score 0 and no spans; so is everything when no
row is labelled. Text whose letters are all of scripts that no language writes gets the language with
most letters in the labelled rows, with score 0 and no spans. Ties go to the language that sorts first. A null doc_id is passed on, repeated
rows give repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import slices, tidied

BUCKETS = 1 << 16
#: Cost of a switch, in nats. A script is a language's if it has this share of its letters.
SWITCH, SCRIPT_SHARE, SMOOTH = 8.0, 0.001, 0.5
# First and last code point of the letters of each script, by Unicode block.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x2FA1F), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
)
_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))
_SCHEMA = "doc_id long, lang_pred string, score double, known double, spans array<struct<start:long,end:long,lang:string>>"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: letter, lower case, script (the last number for all others)."""
    size = sys.maxunicode + 1
    letter = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    lower = np.arange(size, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    script = np.full(size, len(_NAMES), np.int8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = _NAMES.index(name)
    return letter, lower, script


@dataclass
class _Words:
    doc: np.ndarray  # of each word
    start: np.ndarray  # code points, in the document
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # index of the word's first letter among all letters
    trigram: np.ndarray  # of each letter


def _words(texts: list[str]) -> _Words:
    letter, lower, script = _tables()
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[points]
    place = np.flatnonzero(is_letter)
    x = np.where(is_letter, lower[points], 0).astype(np.uint32)
    left = x[place - 1] * (place > 0)
    hashed = (left * np.uint32(0x9E3779B1) ^ x[place] * np.uint32(0x85EBCA77)) + x[place + 1] * np.uint32(0xC2B2AE3D)
    hashed ^= hashed >> np.uint32(15)
    trigram = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    new = np.ones(len(place), bool)
    kind = script[points[place]]
    new[1:] = (np.diff(place) > 1) | (np.diff(kind) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = place[first] if len(first) else np.empty(0, np.int64)
    doc = np.searchsorted(bounds, at, side="right") - 1
    return _Words(doc, at - bounds[doc], (place[last] + 1 if len(first) else at) - bounds[doc],
                  script[points[at]], first, trigram)


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [x or "" for x in rows.column("text").to_pylist()]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows in slices(batch, "text", 3 << 20):
            langs, texts = rows.column("lang").to_pylist(), _texts(rows)
            for lang in dict.fromkeys(langs):
                w = _words([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total = totals.setdefault(lang, np.zeros(BUCKETS + len(_NAMES) + 1, np.int64))
                total[:BUCKETS] += np.bincount(w.trigram, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(w.script, w.end - w.start, len(_NAMES) + 1).astype(np.int64)
    for lang, total in totals.items():
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(total[cells])],
            ["lang", "cell", "n"])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # trigram buckets x languages
    allowed: np.ndarray  # scripts x languages
    prior: int = 0  # the language with most letters


def fit(labelled: DataFrame) -> Model:
    """From text, lang of rows whose lang is not null: per language, a table of fixed size."""
    docs = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    cells = docs.mapInArrow(tidied(_counter), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()
    names, at = np.unique(np.array(table.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
    counts = np.zeros((BUCKETS + len(_NAMES) + 1, len(names)))
    counts[table.column("cell").to_numpy(), at] = table.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS] + SMOOTH, counts[BUCKETS:]
    allowed = scripts > SCRIPT_SHARE * scripts.sum(0)
    prior = int(scripts.sum(0).argmax()) if len(names) else 0
    return Model(names.tolist(), np.log(grams / grams.sum(0)).astype(np.float32), allowed, prior)


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word. Words are in order of ``doc``; all documents go step by step
    together."""
    n, labels = scores.shape
    if not n:
        return np.empty(0, np.int64)
    _, first, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    longer = np.searchsorted(-count, -np.arange(count[0]), side="left")  # documents with more than t words
    back = np.empty((n, labels), np.int8 if labels < 128 else np.int32)
    own = np.arange(labels)
    best = scores[first].astype(np.float64)
    out = np.empty(n, np.int64)
    for t in range(1, count[0]):
        k = longer[t]
        at = first[:k] + t
        before = best[:k]
        top = before.argmax(1)
        switched = before[np.arange(k), top][:, None] - switch
        stays = before >= switched
        back[at] = np.where(stays, own, top[:, None])
        best[:k] = np.where(stays, before, switched) + scores[at]
    state = best.argmax(1)
    for t in range(count[0] - 1, -1, -1):
        k = longer[t]
        at = first[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


def _predictor(model: Model, switch: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.langs, "und"], dtype=object)
        known = len(model.langs)
        for batch in batches:
            for rows in slices(batch, "text", 3 << 20):
                texts = _texts(rows)
                w, n = _words(texts), len(texts)
                pred, score, share = np.full(n, known), np.zeros(n), np.zeros(n)
                ends, starts_of, ends_of, label_of = np.zeros(n + 1, np.int32), w.start[:0], w.start[:0], w.doc[:0]
                if known and len(w.doc):
                    scores = np.empty((len(w.doc), known), np.float32)
                    for i in range(known):
                        scores[:, i] = np.add.reduceat(model.scores[:, i][w.trigram], w.first)
                    fits = model.allowed[w.script]
                    scores[~fits & fits.any(1, keepdims=True)] -= 1e6  # of no use if no language writes the script
                    scores[~fits.any(1)] = 0
                    label = np.where(fits.any(1), viterbi(scores, w.doc, switch), known)
                    letters = np.bincount(w.doc * (known + 1) + label, w.end - w.start, n * (known + 1)).reshape(n, known + 1)
                    total, letters = letters.sum(1), letters[:, :known]
                    some = letters.any(1)
                    pred[total > 0] = model.prior
                    pred[some] = letters[some].argmax(1)
                    score[some] = letters[some].max(1) / total[some]
                    share[some] = letters[some].sum(1) / total[some]
                    new = np.ones(len(label), bool)
                    new[1:] = (np.diff(w.doc) != 0) | (np.diff(label) != 0)
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(label)) - 1
                    first, last = first[label[first] < known], last[label[first] < known]
                    starts_of, ends_of, label_of = w.start[first], w.end[last], label[first]
                    ends = np.searchsorted(w.doc[first], np.arange(n + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(starts_of, pa.int64()), pa.array(ends_of, pa.int64()),
                     pa.array(langs[label_of].tolist(), pa.string())], ["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(langs[pred].tolist(), pa.string()), pa.array(score), pa.array(share), spans],
                    ["doc_id", "lang_pred", "score", "known", "spans"])
    return run


def identify(documents: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end, lang) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(_predictor(model, switch)), _SCHEMA).drop("known")


def held_out(doc_id: Column) -> Column:
    """A quarter of all documents, by a checksum of the id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(documents: DataFrame, model: Model, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """The rows, with all their columns, that have at least this share of their letters in any
    known languages."""
    docs = documents.withColumn("text", F.col("text").cast("string"))
    predict = _predictor(model, switch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 3 << 20):
                asked = pa.RecordBatch.from_arrays(
                    [pa.nulls(rows.num_rows, pa.int64()), rows.column("text")], ["doc_id", "text"])
                good: list[bool] = []
                for found in predict(iter([asked])):
                    good += [lang != "und" and known >= least for lang, known in zip(
                        found.column("lang_pred").to_pylist(), found.column("known").to_pylist(), strict=True)]
                yield rows.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(tidied(run), docs.schema)
