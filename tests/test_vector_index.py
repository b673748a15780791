"""Searches of the stored index against brute force; what they leave out holds nothing better."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import retrieval, vector_index


def clustered(n=900, size=6, groups=12):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(groups)]
    rows = [(i, [x + rng.gauss(0, 0.03) for x in centres[i % groups]]) for i in range(n)]
    rows += [(5000 + i, rows[7][1]) for i in range(n // 2)]  # a third are copies of one vector
    return [*rows, (9000, [0.0] * size), (9001, [0.0] * size)]


def brute(rows, asked, k):
    def score(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 9) + 0.0 if size else 0.0
    out = set()
    for query, wanted in asked:
        best = sorted((-score(wanted, v), key) for key, v in rows)[:k]
        out |= {(query, key, rank) for rank, (_, key) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    return clustered()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(spark.createDataFrame(rows, "id long, v array<double>").repartition(6), path)
    return path


def found(df):
    return {(r.query_id, r.key, r["rank"]) for r in df.collect()}


def test_search_is_exact(spark, rows, index, monkeypatch):
    asked = [(i, [x + 0.01 for x in rows[i][1]]) for i in range(0, 60, 7)] + [(7, rows[7][1]), (99, [0.0] * 6), (98, [-x for x in rows[3][1]])]
    asked = list({q: v for q, v in asked}.items())
    queries = spark.createDataFrame(asked, "query_id int, v array<double>")
    for k in (1, 5, 700):
        assert found(vector_index.search(spark, index, queries, k)) == brute(rows, asked, k)
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 96)
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", 0)
    assert found(vector_index.search(spark, index, queries, 5)) == brute(rows, asked, 5)


def test_cells_are_left_out(spark, rows, index):
    """Near questions visit few cells, and no row of another cell scores more than the floor."""
    blocks, _, cells = vector_index._blocks(spark, index)
    asked = [(i, rows[i][1]) for i in (1, 20, 300)]
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")
    best = {}
    for r in vector_index.search(spark, index, queries, 5).collect():
        best[r.query_id] = min(r.score, best.get(r.query_id, 2.0))
    floored = spark.createDataFrame([(q, v, best[q]) for q, v in asked], "query_id int, vector array<double>, floor double")
    schema = "cell int, query_id int, vector array<double>"
    visits = {(r.query_id, r.cell) for later in (False, True) for r in
              floored.mapInArrow(vector_index._visits(cells, 5, later), schema).collect()}
    assert len(visits) < 3 * len(cells[6].number) / 2
    held = {key: r.cell for r in blocks.select("keys", "cell").collect() for key in r["keys"]}
    left = {(q, key) for q, _ in asked for key, cell in held.items() if (q, cell) not in visits}
    scores = {(q, key): rank for q, key, rank in brute(rows, asked, len(rows))}
    assert left and min(scores[x] for x in left) > 5


def test_every_row_is_indexed_and_cells_are_folders(spark, rows, index):
    back = vector_index.vectors_of(spark, index)
    assert sorted(r.key for r in back.collect()) == sorted(key for key, _ in rows)
    lengths = back.filter("key < 9000").select(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    assert lengths.filter("abs(n - 1) > 1e-9").count() == 0
    plan = spark.read.parquet(f"{index}/blocks").filter("cell = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan


def test_no_shuffle_multiplies_vectors(spark, index, monkeypatch):
    """Whatever the number of question groups, blocks are read once and not exploded."""
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 100)
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", 0)
    blocks, key_type, _ = vector_index._blocks(spark, index)
    visits = spark.range(50).selectExpr("int(1) AS cell", "id AS query_id", "array(1d, 0d, 0d, 0d, 0d, 0d) AS vector")
    plan = vector_index._best_of(blocks, visits, key_type, "long", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Generate" not in plan


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", []), ("e", [1.0, None]), ("f", [nan, 1.0]),
            ("g", [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    vector_index.build(spark.createDataFrame(rows, "id string, v array<float>"), str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", [1.0, 0.1]), ("r", [0.0, 0.0, 1.0]), ("s", [nan, 0.0]), ("t", [1.0])], "query_id string, v array<double>")
    got = sorted((r.query_id, r["rank"], r.key) for r in vector_index.search(spark, str(tmp_path / "i"), asked, 3).collect())
    assert got == [("q", 1, "a"), ("q", 2, None), ("q", 3, "b"), ("r", 1, "g")]
    vector_index.build(spark.createDataFrame([], "id long, v array<float>"), str(tmp_path / "none"))
    assert vector_index.search(spark, str(tmp_path / "none"), asked).count() == 0
    assert vector_index.vectors_of(spark, str(tmp_path / "none")).count() == 0


def test_same_as_the_scan(spark, rows, index):
    queries = spark.createDataFrame([(i, v) for i, v in rows[:40]], "query_id long, v array<double>")
    scan = retrieval.nearest(spark.createDataFrame(rows, "id long, v array<double>"), queries, 5)
    assert found(vector_index.search(spark, index, queries, 5)) == found(scan)
