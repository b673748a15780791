"""Nearest neighbours against brute force, prompts and the index sync."""

import collections
import math
import random

import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.operators import joins, retrieval, text_index
from riskweave.streaming.sync import current_rows, merge_changes, sync_changes


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return dot / size if size else 0.0


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third are copies of one vector
    rows += [(2000, [0.0] * 8)]
    return rows


def brute(vectors, queries, k):
    found = set()
    for q, wanted in queries:
        best = sorted(vectors, key=lambda r: (-round(cosine(wanted, r[1]), 9), r[0]))[:k]
        found |= {(q, key, rank) for rank, (key, _) in enumerate(best, 1)}
    return found


def test_nearest(spark, vectors, monkeypatch):
    queries = [(i, vectors[i][1]) for i in (0, 5, 17)] + [(99, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(7)
    asked = spark.createDataFrame(queries, "query_id int, vector array<double>")
    got = {(r.query_id, r.key, r["rank"]) for r in retrieval.nearest(df, asked, 5).collect()}
    assert got == brute(vectors, queries, 5)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 128)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    blocks = {(r.query_id, r.key, r["rank"]) for r in retrieval.nearest(df, asked, 5).collect()}
    assert blocks == got


def test_nearest_without_queries(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    asked = spark.createDataFrame([], "query_id int, vector array<double>")
    assert retrieval.nearest(df, asked).count() == 0


def test_fewer_vectors_than_k(spark):
    df = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, vector array<double>")
    assert [r.key for r in retrieval.nearest(df, asked).orderBy("rank").collect()] == ["x", "y"]


def test_unusable_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(f"k{i:02}", [1.0, i / 10]) for i in range(20)] + [(f"n{i}", [nan, 1.0]) for i in range(6)]
    rows += [("null", None), ("empty", []), ("hole", [1.0, None]), ("long", [1.0, 0.0, 0.0]), ("inf", [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", [nan, 0.0]), ("none", None)], "query_id string, vector array<float>")
    found = retrieval.nearest(df, asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.key) for r in found] == [("q", "k00"), ("q", "k01"), ("q", "k02")]


def test_many_questions(spark, vectors, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8_000)
    queries = [(i, vectors[i % len(vectors)][1]) for i in range(5_000)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    found = retrieval.nearest(df, spark.createDataFrame(queries, "query_id int, vector array<double>"), 1)
    assert found.count() == 5_000


def brute_text_search(texts, questions, k):
    import collections
    import regex
    counts = {key: collections.Counter(regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())) for key, text in texts}
    counts = {key: c for key, c in counts.items() if c}
    df = collections.Counter(t for c in counts.values() for t in c)

    def entries(c):
        return {t: (math.floor(1000 * math.log((len(counts) + 1) / (df[t] + 1))) + 1)
                * math.floor(1000 * (1 + math.log(n))) // 1000 for t, n in c.items() if t in df}

    vectors = {key: entries(c) for key, c in counts.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = set()
    for query, text in questions:
        own = entries(collections.Counter(regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())))
        scores = {key: sum(x * v.get(t, 0) for t, x in own.items()) / (size(own) * size(v)) for key, v in vectors.items() if own.keys() & v.keys()}
        best = sorted((-s, key) for key, s in scores.items())[:k]
        out |= {(query, rank, key, round(-s, 9)) for rank, (s, key) in enumerate(best, 1)}
    return out


def test_text_vectors_are_read_as_written(spark, tmp_path, monkeypatch):
    """No shuffle on reading; rows of a repeated key, also of other partitions, are one document."""
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 2)
    rows = [(1, "b a a"), (2, "c"), (1, "a Z"), (None, "a"), (3, None), (4, "?"), (5, "b b b"), (1, "q")]
    path = str(tmp_path / "i")
    text_index.build(spark.createDataFrame(rows, "id long, t string").repartition(4), "id", "t", path)
    vectors = text_index.vectors_of(spark, path)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    df = {"a": 1, "b": 2, "c": 1, "q": 1, "z": 1}
    entry = lambda t, n: (math.floor(1000 * math.log(4 / (df[t] + 1))) + 1) * math.floor(1000 * (1 + math.log(n))) // 1000
    assert {r.key: list(zip(r.terms, r.entries)) for r in vectors.collect()} == {
        key: [(t, entry(t, n)) for t, n in sorted(counts.items())]
        for key, counts in {1: {"a": 3, "b": 1, "q": 1, "z": 1}, 2: {"c": 1}, 5: {"b": 3}}.items()}


def test_text_search_against_brute_force(spark, folder, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)] + ["Straße", "naïve", "42"]
    some = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    texts = [(f"c{i:03}", some(rng.randint(1, 60))) for i in range(200)] + [("none", None), ("empty", ""), ("odd", "?! --")]
    texts += [(f"same{i}", texts[4][1]) for i in range(90)] + [("long", some(4000))]
    questions = [(i, some(rng.randint(1, 12))) for i in range(20)] + [(50, None), (51, "unheard of"), (52, texts[4][1])]
    chunks, asked = spark.createDataFrame(texts, "id string, t string"), spark.createDataFrame(questions, "q int, t string")
    expected = brute_text_search(texts, questions, 5)
    for block in (512, 20, 1):
        monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", block)
        path = str(tmp_path / f"index{block}")
        text_index.build(chunks.repartition(3), "id", "t", path)
        found = text_index.search(spark, path, asked, "q", "t", 5)
        assert {(r.query_id, r["rank"], r.key, round(r.score, 9)) for r in found.collect()} == expected
    assert text_index.search(spark, path, asked.limit(0), "q", "t").count() == 0
    text_index.build(chunks.limit(0), "id", "t", str(tmp_path / "none"))
    assert text_index.search(spark, str(tmp_path / "none"), asked, "q", "t").count() == 0


def test_blocks_below_the_floor_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 4)
    rows = [(i, f"common topic{i % 40} filler{i}") for i in range(400)]
    text_index.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", str(tmp_path / "i"))
    visited = []
    real = text_index._scored
    monkeypatch.setattr(text_index, "_scored", lambda p, v, *more: visited.append(v.count()) or real(p, v, *more))
    asked = spark.createDataFrame([(1, "common topic7 filler7"), (2, "topic9")], "q int, t string")
    found = text_index.search(spark, str(tmp_path / "i"), asked, "q", "t", 1).collect()
    assert [r.key for r in sorted(found, key=lambda r: r.query_id)][0] == 7 and found[1].key % 40 in (7, 9)
    assert sum(visited) < 60  # of some 200 pairs of a question and a block


def test_no_pair_of_question_and_posting_is_shuffled(spark, tmp_path, monkeypatch):
    """Questions of common words: a question costs a block at most k rows, whatever it holds."""
    rows = [(i, f"the of and topic{i % 7} filler{i}") for i in range(600)]
    text_index.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", str(tmp_path / "i"))
    asked = spark.createDataFrame([(q, f"the of and topic{q % 7}") for q in range(30)], "q int, t string")
    given = []
    real = text_index.best_by_query
    monkeypatch.setattr(text_index, "best_by_query", lambda found, k: given.append(found) or real(found, k))
    for at_once in (500_000, 20):
        monkeypatch.setattr(text_index, "ASKED_AT_ONCE", at_once)
        given.clear()
        found = text_index.search(spark, str(tmp_path / "i"), asked, "q", "t", 3)
        assert found.count() == 90 and {r.key % 7 - r.query_id % 7 for r in found.collect()} == {0}
        assert given[0].count() <= 30 * 3


def test_an_index_takes_less_disk_than_its_texts(spark, tmp_path):
    """Keys, lengths and terms stand once per block and not at every posting."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(3_000)]
    rows = [(f"source-{i:07}", " ".join(rng.choices(words, k=200))) for i in range(1_500)]
    text_index.build(spark.createDataFrame(rows, "id string, t string").coalesce(2), "id", "t", str(tmp_path / "i"))
    assert 3 * sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet")) < sum(len(t) for _, t in rows)


def test_an_index_is_built_in_small_batches(spark, tmp_path, monkeypatch):
    """Words of many texts would fill a Python worker; the session's own setting is put back."""
    name, given, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], text_index._packed
    before = spark.conf.get(name)
    monkeypatch.setattr(text_index, "_packed", lambda *a: given.append(spark.conf.get(name)) or real(*a))
    rows = [(1, "a b"), (1, "b"), (2, "c")]
    text_index.build(spark.createDataFrame(rows, "id long, t string").coalesce(1), "id", "t", str(tmp_path / "i"))
    assert given[0] == str(8 << 20) and spark.conf.get(name) == before


def test_a_search_moves_no_index(spark, tmp_path):
    """Also where Spark sends no table by itself: blocks meet what is asked without a shuffle of all postings."""
    rows = [(i, f"common topic{i % 40} filler{i}") for i in range(2_000)]
    text_index.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "common topic7 filler7"), (2, "topic9")], "q int, t string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = text_index.search(spark, str(tmp_path / "i"), asked, "q", "t", 2)
        assert found.filter("rank = 1 AND query_id = 1").first().key == 7
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [block" not in plan and "SortMergeJoin [term" not in plan


def test_blocks_and_groups_of_documents(monkeypatch):
    """Blocks end at so many documents or postings, groups at so many postings; nothing is lost."""
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)
    for name, value in (("TaskContext", Task), ("BLOCK_POSTINGS", 6), ("GROUP_POSTINGS", 9)):
        monkeypatch.setattr(text_index, name, value)
    docs = [(f"k{i}", sorted({f"t{(i * j) % 11}" for j in range(1, 2 + i % 5)})) for i in range(30)] + [("long", [f"u{i:02}" for i in range(20)])]

    def batches(size):
        for at in range(0, len(docs), size):
            keys, terms = zip(*docs[at:at + size])
            yield pa.RecordBatch.from_pydict({"key": keys, "terms": terms, "tfs": [[n + 1 for n in range(len(t))] for t in terms]})

    for size in (1, 4, 100):
        rows = pa.Table.from_batches(text_index._blocks(3)(batches(size)))
        blocks = rows.to_pylist()
        assert [k for b in blocks for k in b["keys"]] == [k for k, _ in docs]
        held = [[len(t) for k, t in docs if k in b["keys"]] for b in blocks]
        assert all(len(h) <= 3 and (sum(h) <= 6 or len(h) == 1) for h in held) and len(blocks) < 25
        assert [b["block"] for b in blocks] == [(3 << 32) + i for i in range(len(blocks))]
        groups = {g: sum(sum(h) for b, h in zip(blocks, held) if b["group"] == g) for g in {b["group"] for b in blocks}}
        assert 5 < len(groups) < len(blocks) and all(n <= 9 or n == 20 for n in groups.values())
        again = pa.Table.from_batches(text_index._unblocked(iter(rows.to_batches()))).to_pylist()
        assert [(r["key"], r["terms"], r["tfs"]) for r in again] == [(k, t, [n + 1 for n in range(len(t))]) for k, t in docs]
        seen = pa.Table.from_batches(text_index._vocabulary(iter(rows.to_batches(max_chunksize=2)))).to_pylist()
        wanted = collections.Counter((b["group"], t) for b in blocks for k, ts in docs if k in b["keys"] for t in ts)
        assert {(r["group"], r["term"]): r["n"] for r in seen} == wanted and len(seen) == len(wanted)


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    got = {r.id: r.vector for r in retrieval.vector_index(df, "id", "v").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_document_table_keeps_duplicates(spark):
    part = spark.createDataFrame([("d", "t")], "doc_id string, section_title string")
    assert retrieval.document_table(part, part, part).count() == 3


def test_source_defaults_and_placeholder(spark):
    found = spark.createDataFrame([(1, 1, None, "", None)],
                                  "query_id int, rank int, chunk_text string, doc_title string, score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = retrieval.with_placeholder(asked, retrieval.source_records(found)).orderBy("query_id").collect()
    assert tuple(rows[0]) == (1, 1, "", "Unknown", 0.0)
    assert tuple(rows[1]) == (2, 1, V.NO_RESULT_TEXT, "System", 0.0)
    lists = retrieval.source_lists(spark.createDataFrame(rows)).orderBy("query_id")
    assert [r.s for r in lists.select(retrieval.shows_sources(F.col("sources")).alias("s")).collect()] == [True, False]


def test_prompt_has_history_and_context(spark):
    history = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(14)],
                                    "conv_id int, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "Why?", "C"), (2, "How?", "D")], "query_id int, question string, context string")
    rows = {r.query_id: r.messages for r in retrieval.prompt_messages(asked, history).collect()}
    assert [m.content for m in rows[1][1:-1]] == [f"m{t}" for t in range(4, 14)]
    assert [m.role for m in rows[2]] == ["system", "user"]
    assert rows[1][0].content == V.CHAT_SYSTEM_PROMPT
    assert rows[1][-1].content.startswith("Context from policy documents:\n\nC\n\n---\n\nUser question: Why?\n\n")


def test_sync_is_incremental_and_keeps_the_newest(spark, tmp_path):
    source, changes, checkpoint = (str(tmp_path / n) for n in ("source", "changes", "checkpoint"))
    schema = "chunk_id string, version long, text string, gone boolean"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sync_changes(stream, changes, checkpoint, "chunk_id", "version").awaitTermination()
        table = current_rows(spark, changes, "chunk_id", "version", F.col("gone"))
        return {r.chunk_id: r.text for r in table.collect()}

    assert run([("a", 1, "a1", False), ("b", 1, "b1", False), ("a", 2, "a2", False)]) == {"a": "a2", "b": "b1"}
    assert run([("b", 3, "b3", False), ("c", 1, "c1", False), ("a", 3, None, True)]) == {"b": "b3", "c": "c1"}
    assert run([("b", 2, "late", False)]) == {"b": "b3", "c": "c1"}
    merge_changes(spark, changes, str(tmp_path / "merged"), "chunk_id", "version")
    changes = str(tmp_path / "merged")
    assert run([("c", 2, "c2", False)]) == {"b": "b3", "c": "c2"}
    assert run([("a", 2, "late", False)]) == {"b": "b3", "c": "c2"}


def test_index_follows_its_source(spark, tmp_path):
    """Changed chunks are vectorised in the stream; searches see the newest text only."""
    source, index, checkpoint = (str(tmp_path / n) for n in ("source", "index", "checkpoint"))
    schema = "chunk_id string, version long, chunk_text string"
    first = [("a", 1, "fraud escalation threshold"), ("b", 1, "password rotation policy"), ("c", 1, "claims archive")]
    model = retrieval.fit_text_vectors(spark.createDataFrame(first, schema), "chunk_text")

    def search(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = model.transform(spark.readStream.schema(schema).parquet(source)).select(
            "chunk_id", "version", vector_to_array("_unit", "float32").alias("vector"))
        sync_changes(stream, index, checkpoint, "chunk_id", "version").awaitTermination()
        asked = spark.createDataFrame([(1, "fraud threshold")], "query_id int, chunk_text string")
        found = retrieval.nearest(
            current_rows(spark, index, "chunk_id", "version").select("chunk_id", "vector"),
            retrieval.text_vectors(model, asked, "query_id", "chunk_text"), 1)
        return found.first().key

    assert search(first) == "a"
    assert search([("a", 2, "claims archive"), ("b", 2, "fraud escalation threshold")]) == "b"


def test_sparse_key_join(spark):
    left = spark.createDataFrame([(i, 7 if i % 10 == 0 else None) for i in range(100)], "id long, link int")
    right = spark.createDataFrame([(7, "seven"), (8, "eight")], "key long, name string")
    rows = joins.left_join_sparse_key(left, right, "link", "key", "id").collect()
    assert len(rows) == 100
    assert sum(r.name == "seven" for r in rows) == 10


def test_removed_keys(spark):
    indexed = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    source = spark.createDataFrame([("b",), ("c",)], "chunk_id string")
    assert [r.chunk_id for r in joins.removed_keys(indexed, source, "chunk_id").collect()] == ["a"]
