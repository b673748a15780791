r"""Personal data by rules and a skip-chain conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers; what they find stays. The
field's nodes are a document's tokens that hold a digit or ``@``; any other token can't be part of
such data. Neighbouring nodes share a chain potential. Distant nodes that are alike (the same
token, the same last seven digits, or an address and its local part) share a skip potential with
the first of them, so edges grow with the tokens. Nodes that a rule covers are observed; loopy
belief propagation carries their labels to the others, and a node that then is more likely an
entity than not adds a span.

Potentials are trained by pieces: smoothed counts over all documents, with the rules' labels, give
each shape's and each preceding word's label distribution and each edge kind's pointwise mutual
information. Shapes and words are hashed, so the model has a fixed size.

Null text is empty: no spans. A null doc_id is passed on; repeated rows give repeated results; an
empty table gives an empty result. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm.common import slices, tidied

KINDS = ("email", "ip", "card", "phone")
_O = len(KINDS)  # the label of tokens that are no entity
_LABELS = _O + 1
#: Model size: hashed shapes and preceding words. Weights of the parts, rounds of messages.
SHAPES, WORDS, WORD_WEIGHT, SKIP_WEIGHT, ROUNDS = 4096, 1024, 0.5, 1.5, 12
#: Prior for consistency, as shares, so that the same mix of texts gives the same potentials at every
#: size: pairs that agree, of a label's linked pairs; pairs as if labels were independent; and the
#: least share of all pairs that a label is taken to have. The rules' labels, which the counts come
#: from, miss what the field is there to find.
AGREE, INDEPENDENT, LEAST_LINKED = 1.0, 0.5, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_BREAK = re.compile(r"[\x20\x09-\x0D]")
_EDGE = " \t()[]{}<>\"'`.,;:!?*|#$%&="
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From every "@": the domain is matched to the right; the local part is the run to the left.
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and not _LOCAL.match(text, first - 1):
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done = at + 1 if first == at else done
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _ip_parts(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the rules find, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if _ip_parts(m[0]):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that hold a digit or "@", without punctuation at their edges."""
    at = 0
    while m := _ACTIVE.search(text, at):
        first = max(text.rfind(c, at, m.start()) for c in " \t\n\r\x0b\x0c") + 1 or at
        end = _BREAK.search(text, m.start())
        at = end.start() if end else len(text)
        token = text[first:at]
        left = len(token) - len(token.lstrip(_EDGE))
        yield first + left, first + len(token.rstrip(_EDGE)) if token.strip(_EDGE) else first + left


def _invalid(token: str) -> bool:
    """A number that looks like a card's or an address but fails its check. It has shapes of its
    own, which no rule ever labels."""
    if _IP.fullmatch(token):
        return not _ip_parts(token)
    digits = token.replace("-", "")
    return digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and not _luhn(digits)


def _shape(token: str) -> int:
    kinds = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", token[:64]))
    return zlib.crc32((kinds + "!" * _invalid(token)).encode("utf-8", "replace")) % SHAPES


def _keys(token: str) -> set[str]:
    """Tokens that share a key are alike."""
    low = token.lower()
    keys = {"t" + low.partition("@")[0]}
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 7:
        keys.add("d" + digits[-7:])
    return keys


@dataclass
class _Graph:
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    label: np.ndarray  # the rules' label; _O where no rule covers the token
    chain: np.ndarray
    skip: np.ndarray


def _graph(texts: list[str], base: list[list[tuple[int, int, int]]]) -> _Graph:
    nodes: list[tuple[int, int, int, int, int, int]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for doc, (text, spans) in enumerate(zip(texts, base, strict=True)):
        first_of: dict[str, int] = {}
        by_start = sorted((a, b, k) for k, a, b in spans)
        at = 0
        last_end = None
        for a, b in _tokens(text):
            node = len(nodes)
            while at < len(by_start) and by_start[at][1] <= a:
                at += 1
            label = min((k for s, e, k in by_start[at:at + len(KINDS)] if s < max(b, a + 1) and e > a), default=_O)
            before = text[max(0, a - 24):a].split()
            word = zlib.crc32(before[-1].lower().encode("utf-8", "replace")) % WORDS if before else 0
            nodes.append((doc, a, b, _shape(text[a:b]), word, label))
            if last_end is not None and a - last_end <= 3:
                chain.append((node - 1, node))
            for key in _keys(text[a:b]):
                other = first_of.setdefault(key, node)
                if other != node:
                    skip.append((other, node))
            last_end = b
    columns = np.array(nodes, np.int64).reshape(-1, 6).T
    return _Graph(*columns, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [x or "" for x in rows.column("text").to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: part 0 shape, 1 preceding word, 2 chain, 3 skip; cell and number."""
    totals = [np.zeros(n * _LABELS, np.int64) for n in (SHAPES, WORDS, _LABELS, _LABELS)]
    for batch in batches:
        for rows in slices(batch, "text"):
            texts = _texts(rows)
            g = _graph(texts, [base_spans(t) for t in texts])
            for total, x, y in ((totals[0], g.shape, g.label), (totals[1], g.word, g.label),
                                (totals[2], *g.label[g.chain].T), (totals[3], *g.label[g.skip].T)):
                total += np.bincount(x * _LABELS + y, minlength=len(total))
    for part, total in enumerate(totals):
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cells), part, np.int32)), pa.array(cells.astype(np.int64)), pa.array(total[cells])],
            ["part", "cell", "n"])


@dataclass
class Model:
    shape: np.ndarray  # log-potentials: shapes x labels, words x labels, labels x labels
    word: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _information(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Pointwise mutual information of both ends' labels."""
    both = counts + counts.T + smooth
    both /= both.sum()
    alone = both.sum(1)
    return np.log(both / np.outer(alone, alone))


def _consistency(counts: np.ndarray) -> np.ndarray:
    """The same of linked pairs, with the prior that they agree."""
    both = (counts + counts.T) / max(2 * counts.sum(), 1)
    alone = np.maximum(both.sum(1), LEAST_LINKED)
    both += AGREE * np.diag(alone) + INDEPENDENT * np.outer(alone, alone) / alone.sum()
    both /= both.sum()
    alone = both.sum(1)
    return np.log(both / np.outer(alone, alone))


def fit(documents: DataFrame) -> Model:
    """Potentials from counts over all documents; a table of fixed size reaches the driver."""
    texts = documents.select(F.col("text").cast("string").alias("text"))
    cells = texts.mapInArrow(tidied(_count), "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n"))
    totals = [np.zeros(n * _LABELS) for n in (SHAPES, WORDS, _LABELS, _LABELS)]
    for part, cell, n in cells.collect():
        totals[part][cell] = n
    shape, word, chain, skip = (t.reshape(-1, _LABELS) for t in totals)
    prior = shape.sum(0) + 0.5
    prior /= prior.sum()
    of_shape = (shape + prior) / (shape.sum(1, keepdims=True) + 1)
    of_word = (word + 8 * prior) / (word.sum(1, keepdims=True) + 8)
    return Model(np.log(of_shape), WORD_WEIGHT * np.log(of_word / prior),
                 _information(chain), SKIP_WEIGHT * _consistency(skip))


def _normal(x: np.ndarray) -> np.ndarray:
    return x - np.logaddexp.reduce(x, axis=-1, keepdims=True)


def beliefs(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Log-marginals by loopy belief propagation, messages damped by half. Edge i joins edges[i]
    with the potential tables[kinds[i]]; tables are symmetric."""
    if not len(edges):
        return _normal(unary)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.roll(np.arange(len(source)), len(edges))
    table = tables[np.concatenate([kinds, kinds])]
    message = np.zeros((len(source), unary.shape[1]))

    def total() -> np.ndarray:
        out = unary.copy()
        for label in range(unary.shape[1]):
            out[:, label] += np.bincount(target, message[:, label], len(unary))
        return out

    for _ in range(ROUNDS):
        out = total()[source] - message[back]
        new = _normal(np.logaddexp.reduce(out[:, :, None] + table, axis=1))
        new = 0.5 * message + 0.5 * new
        change = np.abs(new - message).max()
        message = new
        if change < 1e-3:
            break
    return _normal(total())


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    g = _graph(texts, base)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(g.doc):
        return out
    unary = model.shape[g.shape] + model.word[g.word]
    observed = g.label != _O
    unary[observed] = -50.0
    unary[observed, g.label[observed]] = 0.0
    edges = np.concatenate([g.chain, g.skip])
    kinds = np.repeat([0, 1], [len(g.chain), len(g.skip)])
    belief = beliefs(unary, edges, kinds, np.stack([model.chain, model.skip]))
    best = belief.argmax(1)
    chosen = np.flatnonzero(~observed & (best != _O) & (belief.max(1) > np.log(0.5)) & (g.end > g.start))
    joined = {tuple(e) for e in g.chain.tolist()}
    for i in chosen.tolist():
        spans = out[int(g.doc[i])]
        kind, start, end = int(best[i]), int(g.start[i]), int(g.end[i])
        if spans and (i - 1, i) in joined and spans[-1][0] == kind and spans[-1][2] == g.end[i - 1]:
            spans[-1] = (kind, spans[-1][1], end)
        else:
            spans.append((kind, start, end))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finder(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = _texts(rows)
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, base, model)
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64())
                          for k in range(len(KINDS))]
                digest = [hashlib.sha256(_named(s).encode()).hexdigest() for s in base]
                spans = [_named(x + y) for x, y in zip(base, added, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string()),
                     pa.array([len(x) for x in added], pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return run


def find(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the rules'), base_sha256, spans (all), n_added."""
    model = model or fit(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        tidied(_finder(model)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind; overlapping spans count as one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redactor(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for rows in slices(batch, "text"):
                texts = _texts(rows)
                base = [base_spans(t) for t in texts]
                added = added_spans(texts, base, model)
                new = [None if old is None else redacted(t, x + y) for old, t, x, y in zip(
                    rows.column("text").to_pylist(), texts, base, added, strict=True)]
                yield rows.set_column(place, rows.schema.field("text"), pa.array(new, rows.schema.field("text").type))
    return run


def redact(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The same rows and columns, every span in ``text`` replaced by its kind."""
    model = model or fit(documents)
    docs = documents.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(tidied(_redactor(model)), StructType(docs.schema.fields))
