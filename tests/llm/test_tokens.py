"""Encoding, alignment and ranked search against the libraries and brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import alignment, bpe, lexical, pieces, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
OTHER = public_tokenizers.path("piece_bpe_32k.model")
SPACES = "\u0085                 　"
DOCS = "doc_id long, text string, ids string, pair long, times int, rank int, n_docs int"


def library(plain=False):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def noise(rng, n, pool):
    return "".join(rng.choice(pool) for _ in range(n))


def corpus():
    rng = random.Random(4)
    pool = list("aabcdeéß世 \n\t\x1c'stlr12<|>!?.🙂▁") + list(SPACES) + ["  ", "<|endoftext|>", " the", "ing", "'s", "<s>", "<0x41>"]
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    texts = [None, "", " ", "  ", "x", "\n", " x", "x ", "a  b", "don't", "<|endoftext|>", "a  <|endoftext|> b", "▁", "a▁b", "ﬁ é",
             "internationalization " * 3, "The THE the_the 12a"]
    texts += [noise(rng, rng.randint(0, 60), pool) for _ in range(150)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += ["a" * 3000, " ".join(rng.choice(words) for _ in range(20_000)), noise(rng, 4000, "aeinorst")]
    rows = [(i, t, "clash", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return [*rows, rows[40], rows[200], rows[200], (None, "a text without an id", *rows[0][2:])]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pieces_are_the_text():
    rng = random.Random(6)
    texts = [noise(rng, rng.randint(0, 30), list("ab \n\t\x1cÂá‘") + list(SPACES)) for _ in range(3000)]
    for single, pattern in ((False, r"(?= \S)"), (True, r"(?<! )(?= \S)")):
        # Python counts U+001C to U+001F as white space as well, which only cuts less.
        for array in (pa.array(texts), pa.array(["cut off", *texts])[1:]):
            found = pieces.cut(array, single)
            at = np.append(0, np.cumsum(found.counts))
            for i, text in enumerate(texts):
                got = [found.distinct[c] for c in found.code[at[i]:at[i + 1]]]
                assert got == [p for p in re.split(pattern, text) if p]
    assert pieces.cut(pa.array(["", ""])).counts.tolist() == [0, 0]


def test_library_ids_of_whole_texts(rows):
    texts = [t or "" for _, t, *_ in rows]
    for plain in (False, True):
        ids, counts = tokenizing.Tokens(PATH, plain).flat(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        expected = library(plain).encode_batch(texts, add_special_tokens=False)
        assert [p.tolist() for p in parts] == [e.ids for e in expected]


def test_a_full_memory_changes_nothing(rows, monkeypatch):
    texts = pa.array([t or "" for _, t, *_ in rows])
    ids, counts = bpe.Coder(PATH).encode(texts)
    monkeypatch.setattr(pieces, "KEPT_PIECES", 3)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 3)
    small = bpe.Coder(PATH)
    for _ in range(2):
        again, number = small.encode(texts)
        assert (again == ids).all() and (number == counts).all()
    one, other = alignment.Alignment(PATH, OTHER), alignment.Alignment(PATH, OTHER)
    whole = one.align(texts)
    parts = [other.align(texts.slice(i, 25)) for i in range(0, len(texts), 25)]
    for name in ("n_groups", "n_links", "groups_sha256"):
        assert list(whole[name]) == [x for part in parts for x in part[name]]


def test_merges_of_whole_words():
    rng, coder, lib = random.Random(8), bpe.Coder(PATH), library()
    words = [noise(rng, rng.randint(1, 40), "aeinorst") for _ in range(2000)] + ["a" * k for k in range(1, 200)]
    words += [noise(rng, 9, "éßñ世界ж") for _ in range(500)] + [noise(rng, 200, "etaoin") for _ in range(20)]
    for word in words:
        ids = lib.encode(word, add_special_tokens=False).ids
        assert coder.merges.merged(coder._single[np.frombuffer(word.encode(), np.uint8)].tolist()) == ids or not word.isalpha()
    flat, counts = coder.encode_words([w.encode() for w in words])
    assert [p.tolist() for p in np.split(flat, np.cumsum(counts)[:-1])] == [
        lib.encode(w, add_special_tokens=False).ids for w in words]


def test_pairs_that_stay_apart():
    """A pair is compatible if and only if merging its bytes gives the pair back."""
    rng, coder = np.random.default_rng(2), bpe.Coder(PATH)
    a, b = rng.integers(0, 50_256, 3000), rng.integers(0, 50_256, 3000)
    good = coder.merges.compatible(a, b)
    single = coder._single

    def parts(i):
        data = np.frombuffer(coder.bytes.joined(np.array([i])), np.uint8)
        return single[data].tolist()

    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        assert (coder.merges.merged(parts(x) + parts(y)) == [x, y]) == ok
    assert 100 < good.sum() < 2990


def test_encoded_and_decoded(docs, rows, empty):
    lib = library()
    expected = collections.Counter()
    for doc, text, *_ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        expected[doc, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    found = bpe.digests(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(tuple(r) for r in found.collect()) == expected
    encoded = bpe.encode(docs, PATH)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == collections.Counter(
        (doc, tuple(lib.encode(text or "", add_special_tokens=False).ids)) for doc, text, *_ in rows)
    decoded = bpe.decode(encoded, PATH)
    assert collections.Counter(map(tuple, decoded.collect())) == collections.Counter((d, t or "") for d, t, *_ in rows)
    assert bpe.digests(empty, PATH).count() == bpe.encode(empty, PATH).count() == 0


def test_decoding_of_odd_ids(spark):
    lib = library()
    rows = [(1, [220, 50256, 7]), (2, []), (3, None), (4, [163, 100]), (5, [100, 64, 163])]
    found = bpe.decode(spark.createDataFrame(rows, "doc_id int, ids array<long>"), PATH).collect()
    assert {r.doc_id: r.text for r in found} == {d: lib.decode(i or [], skip_special_tokens=False) for d, i in rows}
    with pytest.raises(Exception, match="does not hold"):
        bpe.decode(spark.createDataFrame([(1, [50257])], "doc_id int, ids array<int>"), PATH).collect()


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    lib, sp, byte_of = library(plain=True), SentencePieceProcessor(model_file=OTHER), bpe.byte_alphabet()
    made, counts = [], collections.Counter()
    for doc, text, *_ in rows:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in lib.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            made.append((doc, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            p, q = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = [(x, y) for g, h in groups for x in g for y in h]
        made.append((doc, len(a), len(b), groups, links))
        counts.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = collections.Counter()
    for doc, n_a, n_b, groups, links in made:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links),
            sum(counts[x] for x in links), sha(shown) if n_a else ""] += 1
    return out


def test_aligned(docs, rows, empty, monkeypatch):
    expected = brute_alignment(rows)
    assert sum(key[1] == 0 for key in expected) > 5
    found = alignment.aligned(docs, PATH, OTHER)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, found.collect())) == expected
    monkeypatch.setattr(alignment, "FREQUENT", 20)  # nearly all pairs go through the shuffle
    assert collections.Counter(map(tuple, alignment.aligned(docs, PATH, OTHER).collect())) == expected
    assert alignment.aligned(empty, PATH, OTHER).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(doc, found_terms(text)) for doc, text, *_ in docs]
    held = [(doc, t, collections.Counter(t)) for doc, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t, _ in held)
    df = collections.Counter(t for _, _, c in held for t in c)
    asked = collections.defaultdict(set)
    for item, text, *_ in items:
        asked[item].update(found_terms(text))
    out = collections.Counter()
    for item, terms in asked.items():
        scores = []
        for doc, t, c in held:
            m = 100 - 90 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[x] + 1)))
                        * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms if x in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def search_rows():
    rng = random.Random(12)
    words = [noise(rng, rng.randint(2, 7), "abcdefgñ") for _ in range(250)]
    weights = [1 / (i + 1) for i in range(250)]
    texts = [None, "", " ?! ", "the", "_", "A-Z a-z", "x" * 50_000]
    texts += [" ".join(rng.choices(words, weights, k=rng.randint(1, 90))) for _ in range(400)]
    texts += [texts[20].upper()] * 120 + [" ".join(rng.choices(words, weights, k=9000))]
    docs = [(i, t, "clash", 1, 2, 3, 4) for i, t in enumerate(texts)]
    docs += [docs[30], docs[31], (None, texts[20], *docs[0][2:]), (None, texts[50], *docs[0][2:])]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 150])))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere at all"), (3, "more of the third"), (None, texts[40]), (None, texts[41]), (60, texts[20])]
    return docs, [(*r, 7, 8) for r in items]


def test_ranked_search(spark, empty, monkeypatch):
    docs, items = search_rows()
    documents = spark.createDataFrame(docs, DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, doc_id long, score long")
    expected = brute_search(docs, items, 10)
    found = lexical.search(documents, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, found.collect())) == expected
    for name, value in (("FIRST_MASKS", 2), ("BLOCK_DOCS", 40), ("SENT_TERMS", 0), ("GROUP_BYTES", 3000), ("BROADCAST_ITEMS", 0)):
        monkeypatch.setattr(lexical, name, value)
        assert collections.Counter(map(tuple, lexical.search(documents, asked).collect())) == expected
    assert lexical.search(empty, asked).count() == lexical.search(documents, asked.filter("false")).count() == 0
    assert lexical.search(documents.filter(F.col("text") == "_"), asked).count() == 0


def test_masks_spare_documents():
    """Evaluation ends before the last mask, and what is left could not have been found."""
    rng = np.random.default_rng(3)
    n, terms = 5000, 40
    lists = [np.flatnonzero(rng.random(n) < p) for p in np.linspace(0.9, 0.01, terms)]
    df = np.array([len(x) for x in lists])
    starts, posted = np.cumsum(df) - df, np.concatenate(lists)
    part = rng.integers(300_000, 900_000, len(posted))
    here = [(t, int(1000 * np.log(n / d))) for t, d in enumerate(df)]
    scores = np.zeros(n, np.int64)
    for t, w in here:
        scores[lists[t]] += w * part[starts[t]:starts[t] + df[t]]
    want = np.lexsort((np.arange(n), -scores))[:10]
    met = []
    real = lexical.ranges
    lexical.ranges = lambda first, size: met.append(int(size.sum())) or real(first, size)
    try:
        docs, got = lexical.best_documents(here, starts, df, posted, part, np.maximum.reduceat(part, starts), np.arange(n), 10)
    finally:
        lexical.ranges = real
    assert docs.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
    assert sum(met) < n // 2


def test_plain_pieces_go_to_the_model_and_keep_the_ids_of_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokenizing, "ENCODED_AT_ONCE", 3)
    known, library = tokenizing.Tokens(path), Tokenizer.from_file(path)
    asked = []
    real = known._through_library
    monkeypatch.setattr(known, "_through_library", lambda pieces: asked.extend(pieces) or real(pieces))
    words = [f"wo{'abcdefghij'[i % 10] * (i % 7)}rd{'éжア中'[i % 4]}" for i in range(400)]
    texts = [" ".join(words), " " + ". ".join(words) + "...", " don't 's 'll a's a'. x»… a1 b² ª ×a a  two   three\n four \r five\x00",
             "", " ", " ?", "中 文,字。 か、", "word", " <|endoftext|> a<|endoftext|>."]
    ids, counts = known.flat(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids
    assert not {f" {w}" for w in words} & set(asked) and not {f" {w}." for w in words} & set(asked)
    assert {" a1", " b²", " ×a"} <= set(asked)


def test_texts_are_aligned_a_megabyte_at_once(spark, monkeypatch):
    """The arrays of links are some 50 times the text, so a worker's peak hangs on this."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    sizes = []

    class Both:
        def align(self, texts):
            sizes.append(pc.sum(pc.binary_length(texts)).as_py())
            return {"n_a": np.zeros(len(texts), np.int64)}

    class Documents:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    monkeypatch.setattr(alignment, "_alignment", lambda *paths: Both())
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 100_000] * 40)], ["doc_id", "text"])
    made = list(alignment.linked(Documents(), "a", "b")([batch]))
    assert sum(sizes) == 4_000_000 and max(sizes) <= 1 << 20 and sum(b.num_rows for b in made) == 40
    assert alignment.KEPT_WINDOWS <= 100_000
