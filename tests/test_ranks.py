"""Distributed ranks against brute force, with a group that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskweave.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    groups = ["hot"] * 6 + ["a", "b", "c"]
    values = [0.0] * 3 + [rng.random() * 100 for _ in range(40)]
    return [(i, rng.choice(groups), rng.choice(values), rng.choice([0, 0, 0, 1])) for i in range(3000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, value double, label int").repartition(16)


@pytest.mark.parametrize("bits", [1, 4, 10])
def test_median(frame, rows, bits):
    extra = frame.unionByName(frame.limit(1).withColumns({"grp": F.lit("nulls"), "value": F.lit(None).cast("double")}))
    got = {r.grp: r.m for r in ranks.exact_median(extra, ["grp"], "value", "m", bits).collect()}
    wanted = {g: statistics.median([v for _, gg, v, _ in rows if gg == g]) for g in {r[1] for r in rows}}
    assert got == pytest.approx(wanted)


def test_numbers(frame, rows):
    got = {r.id: r.n for r in ranks.numbered(frame, ["grp"], "id", "n").collect()}
    wanted = {}
    for g in {r[1] for r in rows}:
        for n, i in enumerate(sorted(r[0] for r in rows if r[1] == g), 1):
            wanted[i] = n
    assert got == wanted


def test_numbers_do_not_depend_on_partitioning(frame):
    one = ranks.numbered(frame, ["grp"], "id", "n").select("id", "n")
    two = ranks.numbered(frame.coalesce(1), ["grp"], "id", "n").select("id", "n")
    assert one.exceptAll(two).count() == 0


def test_auc(frame, rows):
    scored = frame.unionByName(frame.limit(1).withColumn("value", F.lit(None).cast("double")))
    row = ranks.roc_auc(scored, "label", "value").first()
    pos = [v for _, _, v, y in rows if y == 1]
    neg = [v for _, _, v, y in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert (row.positives, row.negatives) == (len(pos), len(neg))
    assert row.auc == pytest.approx(won / (len(pos) * len(neg)), abs=1e-12)


def test_auc_agrees_with_mllib(frame):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    mllib = BinaryClassificationEvaluator(rawPredictionCol="value", labelCol="label", numBins=0).evaluate(frame)
    assert ranks.roc_auc(frame, "label", "value").first().auc == pytest.approx(mllib, abs=1e-12)


def test_auc_of_one_class_is_null(frame):
    assert ranks.roc_auc(frame.filter("label = 1"), "label", "value").first().auc is None


@pytest.mark.parametrize("percent", [0, 20, 50, 100])
@pytest.mark.parametrize("digits", [1, 3])
def test_split_is_exact(frame, percent, digits):
    split = ranks.stratified_split(frame, "label", "id", percent, 42, digits)
    counts = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    for n, test in counts.values():
        assert test == (n * percent + 50) // 100


def test_split_repeats(frame):
    ids = [set(r.id for r in ranks.stratified_split(f, "label", "id", 20, 42).filter("is_test").collect())
           for f in (frame, frame.coalesce(1))]
    assert ids[0] == ids[1]


def test_buckets_are_cut_until_they_are_small(spark):
    """Small buckets force several levels; results stay the same."""
    rng = random.Random(21)
    rows = [(rng.choice("abc"), rng.choice([round(rng.random(), 3), 0.5, None])) for _ in range(3000)] + [("d", 1.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    one = {r.g: r.m for r in ranks.exact_median(df, ["g"], "v", "m").collect()}
    many = {r.g: r.m for r in ranks.exact_median(df, ["g"], "v", "m", bits=2, most=3).collect()}
    assert many == one
    for g in "abc":
        assert one[g] == statistics.median(v for k, v in rows if k == g and v is not None)
    keyed = spark.range(4000).select(F.col("id"), (F.col("id") % 3 == 0).alias("label"))
    key = lambda split: {r.id for r in split.filter("is_test").collect()}
    assert key(ranks.stratified_split(keyed, "label", "id", 20, 42)) == key(
        ranks.stratified_split(keyed, "label", "id", 20, 42, bucket_digits=1, most=2))
    weighed = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 2), ("a", 9.0, 4), ("b", 5.0, 0), ("b", None, 7)], "g string, v double, n int")
    assert [(r.g, r.m) for r in ranks.exact_median(weighed, ["g"], "v", "m", weight="n").collect()] == [("a", 2.0)]


def test_few_rows_are_sorted_in_few_parts(spark, monkeypatch):
    df = spark.createDataFrame([("g", i) for i in range(300)], "g string, v long")
    parts, cut = [], ranks.cut_lineage
    monkeypatch.setattr(ranks, "cut_lineage", lambda d: (kept := cut(d), parts.append(kept.rdd.getNumPartitions()))[0])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = ranks.sorted_positions(df, "g", "v", {"at": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.v, r["at"]) for r in placed) == [(i, i) for i in range(300)]
    assert parts[0] <= 8
