"""The text operators against brute force, on rows that are null, empty, long, tied or repeated."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ans, covertree, html, language, mixing, neardup, packing, pii, syncmers, urls
from riskweave.llm.common import components
from riskweave.session import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, cut string, kept int, _id string, size int"


def vocabulary(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus():
    rng, words = random.Random(3), vocabulary()
    texts = [None, "", " \n\t ", "x", "two words", "ünï çødé <|endoftext|>  a\n \nb ", "12 34"]
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base))
        if i % 3 == 0:
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = "changed"
            texts.append("\n".join(base).upper())
    texts.append(" ".join(rng.choice(words) for _ in range(9000)))
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ä", None, "a", "a"]), 0, "clash", 1, "x", 9)
            for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "no id here at all", "en", "b", 1, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, size, percent):
    sets = collections.defaultdict(list)
    for doc, text, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        sets[doc].append(s)
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((root(a), root(b)))
                        parent[q] = p
    return {d: root(d) for d in ids}, sets


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, empty, size, percent):
    p = neardup.MinHash(shingle=size, percent=percent)
    found = neardup.near_duplicates(docs, p).collect()
    expected, sets = brute_components(rows, size, percent)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == expected.get(r.doc_id)
        assert r.n_shingles in [len(s) for s in sets[r.doc_id]]
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert neardup.near_duplicates(empty, p).count() == 0
    kept = neardup.keep_one(docs, p)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(expected.values()))


def test_near_duplicate_blocks_lose_no_link(spark):
    rng, words = random.Random(9), vocabulary(60)
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    p = neardup.MinHash(shingle=3, percent=85, block=16)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    expected, _ = brute_components(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in found} == expected


def test_recall_on_the_given_documents(spark, folder):
    """All links of the given documents, by an exact test of all pairs that share a shingle."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, neardup.MinHash(shingle=3, percent=85)).collect()}
    sets, holders = {}, collections.defaultdict(list)
    for doc, text in docs.select("doc_id", "text").collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
        for shingle in sets[doc]:
            holders[shingle].append(doc)
    links = missed = 0
    shared = collections.Counter((a, b) for docs in holders.values() for i, a in enumerate(docs) for b in docs[:i])
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            missed += found[a] != found[b]
    assert links > 5 and missed == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_base(text):
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, rule in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in digits[::-1]]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0
            if (kind == 0 or kind == 1 and all(int(p) < 256 for p in m[0].split("."))
                    or kind == 2 and 13 <= len(digits) <= 19 and luhn or kind == 3 and 9 <= len(digits) <= 15):
                yield kind, *m.span()


def test_rules_find_what_the_patterns_find():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@@+- 0259(\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == list(brute_base(text)), text
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]
    assert pii.base_spans("1" * 50_000 + "@" * 2000 + "." * 50_000) == []


def test_linked_tokens_get_the_label_that_a_rule_gave(spark):
    filler = "the and of to " * 5
    rows = [(i, f"{filler} call +1 (415) 555-{i:04d} or write a{i}.b@x{i}.example.com "
                f"{filler} room {i} of {i % 7} since 19{i % 90 + 10} {filler} and 12 or 7 {filler}") for i in range(200)]
    rows.append((200, f"+49 30 {filler} +1 (415) 555-0007 10.1.2.3 {filler} and 4242424242424241 {filler}"))
    rows.append((201, f"+1 (700) 555-1234 {filler} +1 (700) 555-1234 170.10.4.5"))
    docs = spark.createDataFrame([*rows, (202, None), (203, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[0].n_phone == 1 and found[0].n_email == 1
    assert found[202].spans == "" and found[203].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "card" not in found[200].spans  # a number that fails its check is left alone
    base = {d: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_base(t)) for d, t in rows}
    assert all(found[d].base_sha256 == hashlib.sha256(b.encode()).hexdigest() for d, b in base.items())
    assert found[201].n_phone == 1 and found[201].n_added >= 1  # the rule gives up on the second
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "555-1234" not in clean[201] and clean[202] is None and filler in clean[200]


def test_label_consistency_does_not_depend_on_the_size_of_the_table():
    phone, other = pii.KINDS.index("phone"), len(pii.KINDS)
    for agreeing in (0, 1, 10):
        counts = np.zeros((other + 1, other + 1))
        counts[other, other], counts[phone, other], counts[phone, phone] = 5000, 10, agreeing
        pulls = []
        for size in (1, 100, 10_000):
            skip = pii._consistency(counts * size)
            pulls.append(skip[phone, phone] - skip[phone, other])
        assert np.ptp(pulls) < 1e-9 and pulls[0] > 5
    assert np.isfinite(pii._consistency(np.zeros((other + 1, other + 1)))).all()


def test_beliefs_equal_exact_marginals_on_a_tree():
    rng = np.random.default_rng(2)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    table = rng.normal(size=(1, 3, 3))
    table = table + table.transpose(0, 2, 1)
    p = np.zeros((4, 3))
    for state in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(table[0, state[a], state[b]] for a, b in edges))
        for i, s in enumerate(state):
            p[i, s] += w
    p /= p.sum(1, keepdims=True)
    assert np.abs(np.exp(pii.beliefs(unary, edges, np.zeros(3, int), table)) - p).max() < 0.02


def test_language_spans_and_scripts(spark):
    rng = random.Random(4)
    en, de = vocabulary(80), [w + "ung" for w in vocabulary(80)]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(en, 30), "en") for i in range(40)] + [(100 + i, text(de, 30), "de") for i in range(40)]
    rows += [(200 + i, "слово за словом идёт текст", "ru") for i in range(5)]
    docs = spark.createDataFrame([*rows, (300, None, "en"), (301, "12 !", "en"), (302, "x", None)],
                                 "doc_id long, text string, lang string")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert np.mean([found[d].lang_pred == lang for d, _, lang in rows]) > 0.95
    assert found[300].lang_pred == found[301].lang_pred == "und" and found[300].score == 0
    mixed = spark.createDataFrame([(1, text(en, 20) + ". " + text(de, 40) + ". " + "слово за словом " * 3)], "doc_id long, text string")
    one = language.identify(mixed, model).first()
    assert [s["lang"] for s in one.spans] == ["en", "de", "ru"] and one.lang_pred == "de" and 0 < one.score < 1
    assert language.keep_known(docs, model).count() == docs.count() - 2
    nothing = language.fit(docs.filter("lang = 'none'"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_letters_of_unlearned_scripts_count_for_no_language(spark):
    rows = [(i, t, lang) for i in range(8) for t, lang in (("the word and the text " * 9, "en"), ("das wort und der satz " * 9, "de"))]
    rows += [(20, "слово за словом идёт текст", None), (21, "the word слово за словом идёт текст", None),
             (22, "漢字かな", None), (23, "the word and the text слово", None), (24, "thewordслово", None), (25, "ᚠᚢᚦ", None), (26, "12 ?!", None), (27, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert {(found[d].lang_pred, found[d].score, len(found[d].spans)) for d in (20, 22, 25)} == {("de", 0.0, 0)}  # most letters
    assert {(found[d].lang_pred, found[d].score) for d in (26, 27)} == {("und", 0.0)}
    assert (found[21].lang_pred, found[21].score) == ("en", 7 / 29) and [tuple(x) for x in found[21].spans] == [(0, 8, "en")]
    assert (found[24].lang_pred, found[24].score) == ("en", 7 / 12)
    assert {r.doc_id for r in language.keep_known(docs, model).collect()} == {*range(8), 23, 24}


def test_markup_in_quotes_and_text_of_odd_elements():
    body = "".join(f"<p>Some words, and more of them, in paragraph {i} of a longer article.</p>" for i in range(6))
    page = f"<article>{body}<p>See <a title='a<b' href=x>link</a> and <img alt=\"one < two\" src=x>this, " \
        "where <math><mi>x</mi></math> is <select><option>few</select>.</p></article>"
    last = html.main_text(page).split("\n\n")[-1]
    assert last == "See link and this, where x is few."
    assert html.main_text("<p title=\"never closed>kept <b>words</b>") .endswith("kept words")
    for bad in ("<a x=\"", "<a x='\" ", "<a \" <a \" ", "<b '\"' "):
        html.main_text(bad * 20_000)


def test_text_of_several_known_languages_is_kept(spark):
    parts = {"en": "the word and the text ", "de": "das wort und der satz ", "fr": "le mot et la phrase "}
    rows = [(i, t * 9, lang) for i in range(8) for lang, t in parts.items()]
    rows.append((30, " ".join(parts[x] * n for x, n in (("en", 8), ("de", 6), ("fr", 6))), None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    one = language.identify(docs.filter("doc_id = 30"), model).first()
    assert one.score < 0.5 and {x["lang"] for x in one.spans} == set(parts)
    assert language.keep_known(docs, model).filter("doc_id = 30").count() == 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores, doc = rng.normal(size=(9, 3)), np.array([0, 0, 0, 0, 2, 5, 5, 5, 5])
    got = language.viterbi(scores, doc, 0.7)
    value = lambda rows, path: sum(scores[r, s] for r, s in zip(rows, path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
    for d in (0, 2, 5):
        at = np.flatnonzero(doc == d)
        best = max(value(at, p) for p in np.ndindex(*[3] * len(at)))
        assert abs(value(at, got[at].tolist()) - best) < 1e-9


def encoded(rows, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [(doc, [*t.encode(text or "", add_special_tokens=False).ids, end]) for doc, text, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, rows, empty):
    found = packing.pack(docs, PATH).collect()
    expected = collections.Counter()
    for doc, ids in encoded(rows, 2):
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc, i, a, b - a, crc(ids[a:b])] += 1
    assert collections.Counter(tuple(r[:5]) for r in found) == expected
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in found) // 1024) + 1
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("capacity, width, low, high, n", [
    (10, 1, 1, 10, 300), (37, 1, 1, 37, 300), (37, 4, 1, 37, 2000), (64, 3, 1, 9, 500), (64, 2, 17, 31, 500), (40, 1, 1, 5, 7)])
def test_rounds_are_best_fit_decreasing(spark, capacity, width, low, high, n):
    rng = random.Random(8)
    sizes = [rng.randint(low, high) for _ in range(n)]
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit if fit is not None else capacity) - s)
    lengths = spark.createDataFrame(list(collections.Counter(sizes).items()), "length long, count long")
    inside, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.plan(lengths, capacity, width).collect():
        ranks[r.length].append((r["rank"], r["each"] * r.n))
        for sequence in range(r.first, r.first + r.n):
            inside[sequence] += [(r.offset + i * r.length, r.length) for i in range(r["each"])]
    for parts in [*inside.values(), *ranks.values()]:
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert {k: sum(c for _, c in v) for k, v in ranks.items()} == collections.Counter(sizes)
    assert all(sum(length for _, length in parts) <= capacity for parts in inside.values())
    # One length a round is best-fit decreasing itself; wider rounds are near it.
    assert len(inside) == len(gaps) if width == 1 else len(inside) <= 1.1 * len(gaps) + 1


def test_segments_of_other_lanes_are_read(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 900, 5000).astype(np.uint32)
    with monkeypatch.context() as earlier:
        earlier.setattr(ans, "LANES", 64)
        data = ans.encode_segment([3, 9], [4000, 1000], ids)
    docs, lengths, back = ans.decode_segment(data)
    assert docs == [3, 9] and lengths.tolist() == [4000, 1000] and (back == ids).all()


def test_token_files_round_trip(spark, docs, rows, empty):
    folder = scratch_dir(spark, "test-tokens")
    ans.write_tokens(docs, folder, PATH)
    ordered = sorted(encoded(rows, 0), key=lambda r: (r[0] is not None, r[0] or 0))
    digests = sorted(ans.read_tokens(spark, folder, digest=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in digests] == [(d, len(i), crc(i)) for d, i in ordered]
    assert [r.start for r in digests] == np.cumsum([0, *[len(i) for _, i in ordered]])[:-1].tolist()
    whole = sorted(ans.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.ids for r in whole] == [i for _, i in ordered]
    none = scratch_dir(spark, "test-tokens")
    ans.write_tokens(empty, none, PATH)
    assert ans.read_tokens(spark, none, digest=True).count() == 0


@pytest.mark.parametrize("n,kinds", [(1, 1), (700, 1), (700, 300), (300_000, 50_000)])
def test_coder_and_checksums(n, kinds):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(1, kinds).astype(np.uint32) - 1
    data = ans.encode_segment([None, 7], [n - 1, 1], ids)
    docs, lengths, back = ans.decode_segment(data)
    assert docs == [None, 7] and lengths.tolist() == [n - 1, 1] and (back == ids).all()
    with pytest.raises(ValueError):
        ans.decode_segment(data[:40] + bytes([data[40] ^ 1]) + data[41:])


def test_mixture(docs, rows, empty):
    found = mixing.mixture(docs).collect()
    sizes = [(doc, source, len(WORD.findall(text or ""))) for doc, text, _, source, *_ in rows]
    per = collections.Counter()
    for _, source, size in sizes:
        per[source] += size
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(per.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * per[s]]
        if not full:
            break
        target.update({s: 3 * per[s] for s in full})
        open_ -= set(full)
    target.update(share)
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((d or -1, n) for d, _, n in sizes)
    taken = collections.Counter()
    for r in found:
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in per)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    real = mixing.mixed(docs)
    assert real.columns == docs.columns
    words = collections.Counter()
    for r in real.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == +taken
    plan = real._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan  # texts stay where they are
    kept = mixing.BROADCAST_BYTES
    try:
        mixing.BROADCAST_BYTES = 0
        assert sorted(map(str, mixing.mixture(docs).collect())) == sorted(map(str, found))
        assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, real.collect()))
    finally:
        mixing.BROADCAST_BYTES = kept
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    found = syncmers.fingerprints(docs).collect()
    ordered = sorted(rows, key=lambda r: r[1] or "")
    ordered.sort(key=lambda r: r[0] if r[0] is not None else -1, reverse=True)
    expected = collections.Counter()
    for i, (doc, text, *_) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        expected[doc, len(text), hashlib.sha256((text[:len(text) - k] + other[:k]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    prints = collections.defaultdict(set)
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in found:
        prints[by_id[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in found if r.n_chars > 300]
    assert min(r.near_edited for r in long) > 0.4
    assert syncmers.fingerprints(empty).count() == 0
    one = syncmers.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1


def test_fingerprints_hold_all_anchors(spark):
    rng = random.Random(6)
    words = [[f"{side}{rng.randrange(10 ** 9)}" for _ in range(5000)] for side in "ab"]
    shared = [f"c{i}" for i in range(60)]
    a, b = words[0][:3000] + shared + words[0][3000:], words[1][:3100] + shared + words[1][3100:]
    changed = [*a[:1234], "changed", *a[1235:]]
    far = words[1][:100] + shared + words[1][100:]
    rows = [(i, " ".join(t)) for i, t in ((4, a), (3, b), (2, a), (1, changed), (0, far))]
    found = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.005 < found[4].near_next < 0.02  # 58 of some 5,060 runs
    assert found[2].fingerprint != found[1].fingerprint and 0.99 < found[2].near_next < 1
    assert found[1].near_next == 0  # the passage is there, but elsewhere
    n = F.lit(4_000_000)
    bits = syncmers.place_bits(n)
    one = spark.range(1).select(*[F.array(syncmers._packed(F.xxhash64(F.lit(5)), F.lit(at), bits)).alias(f"at{at}")
                                  for at in (3_000_000, 1_100_000)])
    same, moved = (syncmers.likeness(F.col("at3000000"), F.col(c), n, n) for c in one.columns)
    assert tuple(one.select(same, moved).first()) == (1.0, 0.0)
    short = one.select("at1100000", F.array(syncmers._packed(F.xxhash64(F.lit(5)), F.lit(900_000), F.lit(20))).alias("b"))
    assert short.select(syncmers.likeness(F.col("at1100000"), F.col("b"), n, F.lit(1_000_000))).first()[0] == 1


def test_url_rules(spark):
    rng, parts = random.Random(2), ["a", "net", "example", "com", "org", "xnet", "NET", ""]
    made = ["".join([rng.choice(["http://", "https://", "", "x"]), ".".join(rng.choices(parts, k=rng.randint(1, 4))),
                     rng.choice(["", "/", "/en/", "/fr/1", "/de/x?y#z", "/en", "#/fr/", "?a://b/net/", "/\n/"])]) for _ in range(600)]
    rows = [*enumerate(made), (None, None), (0, made[0]), (7, None), (8, "")]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in rows], "page_id long, url string, html string, rule int")
    rules = [*urls.RULES, urls.Rule("block", "example.com", "/"), urls.Rule("allow", "a.net", "/")]
    for given in (urls.RULES, rules):
        expected = collections.Counter()
        for i, url in rows:
            m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            fits = [r for r in given if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
            expected[i, host, path, best and best.text, best.verdict if best else "allow"] += 1
        assert collections.Counter(tuple(r) for r in urls.judge(pages, given).collect()) == expected
    assert urls.judge(pages.limit(0)).count() == 0


def test_bloom_cascade_is_exact(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    levels = urls.cascade(keys.filter("key % 50 = 0"), keys)
    told = keys.filter(urls.member(F.col("key"), levels))
    assert len(levels) > 1 and sorted(int(r.key) for r in told.collect()) == list(range(0, 5000, 50))


@pytest.mark.parametrize("dim,spread", [(2, 0.02), (16, 1.0)])
def test_top_inner_products(spark, dim, spread):
    rng = np.random.default_rng(dim)
    x = np.repeat(rng.normal(size=(8, dim)), 300, 0) + spread * rng.normal(size=(2400, dim))
    x[100:900] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(50, None, 0), (None, rows[0][1], 0), (3000, [float("nan")] * dim, 0), (3050, [1.0, None], 0), (2450, [], 0)]
    found = covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int"), F.pmod("vec_id", F.lit(50)) == 0)
    ids, whole = np.array([*range(2400), 2450]), np.vstack([np.floor(256 * x), np.zeros(dim)]).astype(np.int64)
    expected = []
    for q in ids[ids % 50 == 0]:
        s = whole @ whole[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        expected += [(q, rank + 1, ids[i], s[i]) for rank, i in enumerate(order)]
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_dual_tree_prunes_far_nodes():
    rng = np.random.default_rng(0)
    points = np.unique(np.round(np.concatenate([rng.normal(size=(40, 3)), 100 + rng.normal(size=(40, 3))]), 3), axis=0)
    tree = covertree.cover_tree(points)
    assert sorted(c for c in tree.cell if c >= 0) == list(range(len(points)))
    scores = points @ points.T
    worst = np.sort(scores, 1)[:, -5]
    pairs = {tuple(p) for p in covertree.surviving(tree, np.zeros(len(points)), np.zeros(len(points)), worst).tolist()}
    assert all((i, j) in pairs for i, j in np.argwhere(scores >= worst[:, None]))
    assert len(pairs) < len(points) ** 2 / 2
    wide = covertree.products(np.array([[2.0 ** 40, 1]]), np.array([[2.0 ** 20, 1]]))
    assert wide[0, 0] == 2 ** 60 + 1


PAGE = """<html><head><title>T</title><script>if (a < b) {"</p>"}</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a></header><div id="nav-main"><a href="/a">One</a></div>
<div class="layout"><div class="post-content"><h1>A&nbsp;title</h1><p>First, of some length, with commas &amp; more
 words than that, <b>bold</b> and <a href=x>a link</a>.<br>Next line<p>Second, also long enough, with a comma or two.
<div class="ad-box">Buy now, it is cheap, really, yes</div><ul><li>Point one, fine<li>Point two</ul></div>
<div class="sidebar"><p>Related, stories, here, and, there, many, commas</p></div></div>
<section id="comments"><p>I think, as a reader, that this, too, is long, long, long text, see?</p></section>
<form>Name</form><div class="cookie-notice">We use cookies, a lot</div><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    text = html.main_text(PAGE)
    assert text == ("A title\n\nFirst, of some length, with commas & more words than that, bold and a link. Next line\n\n"
                    "Second, also long enough, with a comma or two.\n\nPoint one, fine\n\nPoint two")
    for odd in ("", "<", "<p", "a < b", "<!-- x", "<script>x", "</p></div>", "<p a='", "<>" * 3, "<b>only</b>"):
        html.main_text(odd)
    assert html.main_text("a < b") == "a < b" and html.main_text("<b>only</b>") == "only"
    html.main_text("<a '" * 20_000 + "<div>" * 5000)
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in found] == [(1, len(text))] * 2 + [(2, 0), (None, 0)]


ARTICLE = "<h1>A title</h1>" + "".join(f"<p>Paragraph {i}, long enough, with commas, to be a part of the article's text.</p>" for i in range(6))


@pytest.mark.parametrize("before,after", [
    ("<form action=x>", "</form>"), ("<div class='header-fixed'>", "</div>"), ("<div class='nav-open'>", "</div>"),
    ("<div id='sidebar-right'>", "</div>"), ("<article class='comments-open'>", "</article>"), ("<aside>", "</aside>"),
    ("<form><div class='nav-open'><article>", "</article></div></form>"), ("<div class=sidebar><main>", "</main></div>")])
def test_main_text_inside_marked_wrappers(before, after):
    around = ("<div class='nav-main'><a href=x>Home, sweet, home</a></div><form><label>Name</label><button>Go</button></form>"
              "<section id=comments><article class=comment><p>I, as a reader, think, so, long.</p></article></section>"
              "<div class='cookie-notice'><p>We use cookies, and so on, and more of them, and more.</p></div><footer>End, of, it</footer>")
    inner = "<div class=sidebar>Other, stories, here</div><button>Send</button>"
    text = html.main_text(f"<body>{before}{inner}{ARTICLE}{after}{around}</body>")
    assert text == html.main_text(f"<body><article>{ARTICLE}</article></body>")
    outside = html.main_text(f"<body><div class=post>{ARTICLE}</div>{before}<p>Some, other, small part, of the page.</p>{after}</body>")
    assert "small part" not in outside and outside.count("Paragraph") == 6


def test_main_text_keeps_what_belongs_to_the_article():
    links = "<ul><li><a href=x>First source of it</a><li><a href=y>Second source</a></ul>"
    assert "First source" in html.main_text(f"<body><article>{ARTICLE}{links}</article></body>")
    assert "First source" not in html.main_text(f"<body><article>{ARTICLE}<div class=related-links>{links}</div></article></body>")
    assert "Second source" not in html.main_text(f"<body><div>{ARTICLE}</div><div>{links}</div></body>")
    assert html.main_text(f"<body><p>A short intro.</p><div>{ARTICLE}</div></body>").startswith("A short intro.")
    assert "Paragraph 5" in html.main_text(f"<body>\u0130<script>x</SCRIPT><div>{ARTICLE}</div></body>")


def test_top_k_over_many_blocks_and_groups(spark, monkeypatch):
    """Blocks and query groups of 256 rows, a third of all vectors equal."""
    monkeypatch.setattr(covertree, "BLOCK_BYTES", 1)
    monkeypatch.setattr(covertree, "ROWS_PER_CENTRE", 64)
    monkeypatch.setattr(covertree, "HELD", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1_500, 8)) + 4 * rng.integers(0, 2, (1_500, 8))
    x[rng.random(1_500) < 1 / 3] = x[7]
    found = covertree.top_k(spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(3)) == 0)
    whole = np.floor(256 * x).astype(np.int64)
    scores = whole @ whole.T
    want = set()
    for q in range(0, 1_500, 3):
        others = [i for i in np.lexsort((np.arange(1_500), -scores[q])).tolist() if i != q][:5]
        want |= {(q, rank, i, int(scores[q, i])) for rank, i in enumerate(others, 1)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_blocks_hold_neighbouring_cells_and_split_large_ones():
    got = covertree.blocks_of([3, 1, 2, 0], {0: 4, 1: 5, 2: 25, 3: 4}, 10)
    assert got == [(3, 0, 1), (1, 0, 1), (2, 1, 3), (0, 4, 1)]


def test_workers_forget_what_other_operators_remember():
    from riskweave.llm import common, tokenizing

    tokenizing.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    list(common.tidied(iter, tokenizing.REMEMBERED_AS)([]))
    assert common.REMEMBERED[tokenizing.REMEMBERED_AS]
    list(common.tidied(iter)([]))
    assert not common.REMEMBERED[tokenizing.REMEMBERED_AS]


def test_a_packing_worker_holds_little_text_and_few_words(monkeypatch):
    """Two workers share an executor's memory with its heap, so neither may hold many megabytes at once."""
    path, asked = public_tokenizers.path("byte_bpe_50k.json"), []
    known = packing.tokens(path, kept=50)
    with_end = known.with_end
    monkeypatch.setattr(known, "with_end", lambda texts, end_id: asked.append(texts.nbytes) or with_end(texts, end_id))
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 50)
    docs = [(i, " ".join(f"w{(i * 37 + j) % 9_000:04d}" for j in range(500))) for i in range(1_500)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs])
    rows = [r for b in packing._piece_maker(path, 2, 1024)(iter([batch])) for r in b.to_pylist()]
    assert sum(asked) > 4 << 20 and max(asked) < 1.1 * (1 << 20)
    assert len(known.memo._known) == 50
    # The ids are those of a worker that holds all of it.
    ids, counts = packing.tokens(path).with_end(batch.column("text"), 2)
    whole, at = {}, 0
    for (i, _), n in zip(docs, counts.tolist(), strict=True):
        whole[i], at = ids[at:at + n].astype("<u4"), at + n
    assert sum(r["length"] for r in rows) == len(ids)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())


def test_a_worker_holds_one_tokenizer():
    from riskweave.llm import common, tokenizing

    path = public_tokenizers.path("byte_bpe_50k.json")
    for kept in (None, 50, None):
        assert tokenizing.tokens(path, kept=kept) is tokenizing.tokens(path, kept=kept)
        assert len(common.REMEMBERED[tokenizing.REMEMBERED_AS]) == 1


def test_a_round_is_one_plan_with_one_exchange(spark):
    """Every round costs the driver a plan: gaps that stay and places come from one pass over the runs."""
    gaps = spark.createDataFrame([(9, 0, 2), (7, 2, 1), (7, 5, 3), (5, 8, 4), (3, 12, 2), (40, 14, 30)], packing._GAPS)
    lengths = spark.createDataFrame([(5, 4), (4, 3), (2, 1)], "length long, count long")
    found = packing.sweep(gaps, lengths, 4, 5, 40)
    said = found._jdf.queryExecution().sparkPlan().toString()
    assert said.count("Window [") <= 5 and said.count("Sort [") == 0
    planned = found._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange ") == 1, planned
    rows = found.collect()
    left = sorted((r.gap, r.first, r.n) for r in rows if r.gap is not None)
    placed = sorted((r.length, r.rank, r.each, r.offset, r.first, r.n) for r in rows if r.length is not None)
    # The tightest seven that fit are taken, the longer pieces get the wider of them.
    assert placed == [(4, 0, 1, 35, 9, 3), (5, 0, 1, 33, 5, 3), (5, 3, 1, 35, 8, 1)]
    assert left == [(0, 8, 1), (1, 9, 3), (2, 5, 3), (3, 12, 2), (7, 2, 1), (9, 0, 2), (40, 14, 30)]


def test_rounds_are_not_planned_anew(spark):
    before, seen = spark.conf.get("spark.sql.adaptive.enabled"), []
    sweep = packing.sweep
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "sweep", lambda *a: seen.append(spark.conf.get("spark.sql.adaptive.enabled")) or sweep(*a))
        packing.plan(spark.createDataFrame([(700, 2), (300, 1), (40, 5)], "length long, count long"), 1024).collect()
        assert set(seen) == {"false"} and len(seen) == 3
        m.setattr(packing, "sweep", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            packing.plan(spark.createDataFrame([(700, 2)], "length long, count long"), 1024)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
