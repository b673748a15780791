"""Learning: codes, weights, report, fit and the saved model."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.operators import boosting, learning
from riskweave.plans import learning as plans


def test_report_by_hand(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r.row: r for r in learning.classification_report(df, "label", "prediction").collect()}
    assert report["1"].precision == pytest.approx(0.6) and report["1"].recall == pytest.approx(0.75)
    assert report["0"].f1 == pytest.approx(2 * 0.8 * (4 / 6) / (0.8 + 4 / 6))
    assert report["accuracy"].f1 == pytest.approx(0.7) and report["accuracy"].support == 10
    assert report["macro avg"].recall == pytest.approx((0.75 + 4 / 6) / 2)
    assert report["weighted avg"].recall == pytest.approx(0.7)


def test_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    report = {r.row: r for r in learning.classification_report(df, "label", "prediction").collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0.0, 0.0, 0.0, 1)


def test_champion_compares_numbers(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10"), ("n", "2")], "model string, version string")
    assert {r.model: r.version for r in learning.champions(df).collect()} == {"m": "10", "n": "2"}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(True,)] * 2 + [(False,)] * 6, "is_flagged boolean")
    weights = {r.is_flagged: r.weight for r in learning.class_weights(df).collect()}
    assert weights == {True: 8 / 4, False: 8 / 12}


def test_fit_save_load_score(spark, folder, tmp_path):
    features = plans._features(spark, folder)
    split = learning.train_test(features).cache()
    model = learning.fit(split.filter("not is_test"), trees=5)
    test = split.filter("is_test")
    predictions = learning.predict(model, test).cache()
    assert predictions.count() == test.count()
    metrics = {r.name: r.value for r in learning.run_metrics(predictions, "run", {"trees": 5}).collect()}
    assert metrics["test_auc"] > 0.6 and metrics["trees"] == 5.0
    learning.save_model(spark, model, features, str(tmp_path))
    again = learning.predict(learning.load_model(str(tmp_path)), test)
    assert again.exceptAll(predictions).count() == 0
    unseen = test.limit(1).withColumns({"region": F.lit("Nowhere"), "flagged_claims_pct": F.lit(None).cast("double")})
    assert learning.predict(model, unseen).count() == 1
    assert spark.read.json(f"{tmp_path}/example").count() == 3
    assert "claim_amount_hkd" in spark.read.text(f"{tmp_path}/schema").first()[0]


def _claims(spark, rows):
    kinds = ", ".join(f"{c} {'string' if c in V.CATEGORICAL_FEATURES else 'double'}" for c in V.FEATURES)
    values = [(i, *(None if c in gone else "v%d" % (i % 3) if c in V.CATEGORICAL_FEATURES else float(i % 40) for c in V.FEATURES), i % 40 > 25)
              for i, gone in rows]
    return spark.createDataFrame(values, f"claim_id long, {kinds}, is_flagged boolean")


def test_a_model_is_saved_with_signature_and_training_rows(spark, tmp_path):
    """Types and nulls of the training rows and of what the model predicts of them; their first three rows."""
    train = _claims(spark, [(i, ("region",) if i == 90 else ()) for i in range(120, 20, -1)])
    model = learning.fit(train, trees=2)
    learning.save_model(spark, model, train.repartition(3), str(tmp_path))
    seen = learning.saved_signature(spark, str(tmp_path))
    assert [(c["name"], c["type"], c["required"]) for c in seen["inputs"]] == [
        (c, "string" if c in V.CATEGORICAL_FEATURES else "double", c != "region") for c in V.FEATURES]
    assert seen["outputs"] == [{"name": "prediction", "type": "int", "required": True}]
    example = learning.saved_example(spark, str(tmp_path))
    assert example.collect() == train.filter("claim_id <= 23").orderBy("claim_id").select(*V.FEATURES).collect()
    assert learning.predict(model, example.withColumn("claim_id", F.lit(0))).count() == 3


def test_a_saved_model_becomes_a_version(spark, tmp_path):
    train, registry = _claims(spark, [(i, ()) for i in range(60)]), str(tmp_path / "models")
    model = learning.fit(train, trees=2)
    saved = [learning.save_model(spark, model, train, str(tmp_path / n), registry=registry) for n in ("a", "b")]
    assert saved == [0, 1]
    for version, name in ((1, "b"), (0, "a")):
        learning.set_alias(spark, registry, "champion", version)
        assert learning.registered_model(spark, registry) == str(tmp_path / name)
    assert learning.load_model(learning.registered_model(spark, registry)).to_json() == model.to_json()


def test_score_properties_look_at_signature_and_example(spark, folder, monkeypatch):
    monkeypatch.setattr(plans, "TREES", 3)
    monkeypatch.setattr(plans, "_SAVED", {})
    claims = plans._features(spark, folder).count()
    assert plans.m13_score_properties(spark, folder).filter("sound").count() == claims
    train = plans._train_rows(spark, folder).orderBy("claim_id").limit(3).select(*V.FEATURES)
    assert learning.saved_example(spark, plans._saved(spark, folder)).collect() == train.collect()
    real = learning.saved_signature
    monkeypatch.setattr(learning, "saved_signature", lambda *a: {**real(*a), "outputs": []})
    assert plans.m13_score_properties(spark, folder).filter("sound").count() == 0


def test_codes_count_from_zero(spark, folder):
    codes = learning.category_codes(plans._features(spark, folder))
    for c in V.CATEGORICAL_FEATURES:
        rows = sorted((r.value, r.code) for r in codes.filter(F.col("feature") == c).collect())
        assert [code for _, code in rows] == list(range(len(rows)))


def test_fit_with_many_categories_and_a_null_label(spark):
    from riskweave import fixed_values as V
    from riskweave.operators import learning
    rows = spark.range(400).selectExpr("id AS claim_id", "id * 1.0 AS claim_amount_hkd", "int(id % 9) AS processing_days",
        "'a' AS claim_type", "'b' AS prov_type", "concat('r', id % 80) AS region", "'c' AS submission_channel",
        "1.0 AS flagged_claims_pct", "'low' AS risk_tier", "CASE WHEN id = 7 THEN null ELSE id % 3 = 0 END AS is_flagged")
    model = learning.fit(rows.select("claim_id", *V.FEATURES, "is_flagged"), trees=2)
    assert learning.predict(model, rows).count() == 400


def brute_tree(bins, labels, scores, weights, leaves, max_depth, least_rows, step):
    """Leaf after leaf is opened, always the one of highest gain; returns each row's value."""
    p = 1 / (1 + np.exp(-scores))
    w = np.array(weights)[labels]
    g, h = np.rint((p - labels) * w * 2 ** 20), np.rint(p * (1 - p) * w * 2 ** 20)

    def best(rows):
        found = (0.0, -1, -1)
        for f in range(bins.shape[1]):
            for cut in range(bins[:, f].max()):
                low = bins[rows, f] <= cut
                a, b = rows[low], rows[~low]
                if min(len(a), len(b)) >= least_rows and min(h[a].sum(), h[b].sum()) >= 1e-3 * 2 ** 20:
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > found[0] and gain > 1e-9 * 2 ** 20:
                        found = (gain, f, cut)
        return found

    open_ = [(np.arange(len(bins)), 0)]
    while len(open_) < leaves:
        gains = [best(rows) if depth < max_depth else (0.0, -1, -1) for rows, depth in open_]
        at = max(range(len(open_)), key=lambda i: gains[i][0])
        if not gains[at][0]:
            break
        rows, depth = open_.pop(at)
        low = bins[rows, gains[at][1]] <= gains[at][2]
        open_ += [(rows[low], depth + 1), (rows[~low], depth + 1)]
    out = np.zeros(len(bins))
    for rows, _ in open_:
        out[rows] = -step * g[rows].sum() / h[rows].sum()
    return out, len(open_)


def test_trees_are_grown_leaf_by_leaf(spark):
    rng = np.random.default_rng(4)
    n = 900
    x, y = rng.normal(size=n), rng.integers(0, 12, n)
    kind = rng.choice(["a", "b", "c", "ä", "zz"], n)
    label = ((x > 0.3) ^ (y > 6) ^ (kind == "b")) | (rng.random(n) < 0.1)
    rows = [(i, float(x[i]), int(y[i]) if i % 50 else None, str(kind[i]), bool(label[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, x double, y int, kind string, label boolean").repartition(5)
    model = boosting.fit(df, ["x", "y", "kind"], ["kind"], "label", trees=3, leaves=7, max_depth=4, step=0.3, least_rows=20)
    bins = model.binned(pa.RecordBatch.from_pandas(pd.DataFrame(
        [(r[1], r[2], r[3]) for r in rows], columns=["x", "y", "kind"]), preserve_index=False)).astype(int)
    labels, scores = label.astype(int), np.zeros(n)
    weights = [n / 2 / (n - labels.sum()), n / 2 / labels.sum()]
    for tree in model.trees:
        value, count = brute_tree(bins, labels, scores, weights, 7, 4, 20, 0.3)
        assert np.allclose(tree.scores(bins), value, rtol=1e-9) and sum(child < 0 for child in tree.left) == count
        scores = scores + value
    again = boosting.fit(df.coalesce(1), ["x", "y", "kind"], ["kind"], "label", trees=3, leaves=7, max_depth=4, step=0.3)
    assert again.to_json() == model.to_json() == boosting.Booster.from_json(model.to_json()).to_json()


def test_fit_over_many_tasks_and_kept_scores(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "(id * 7919) % 1000 / 10.0 AS x", "((id * 7919) % 1000 > 600) = (id % 5 < 4) AS label")
    one = boosting.fit(rows, ["x"], [], "label", trees=5, leaves=4)
    for name, value in (("BLOCK_ROWS", 100), ("TASK_ROWS", 500), ("KEPT_TREES", 2)):
        monkeypatch.setattr(boosting, name, value)
    assert boosting.fit(rows.repartition(6), ["x"], [], "label", trees=5, leaves=4).to_json() == one.to_json()


def test_a_pass_is_one_job_on_many_tasks(spark, monkeypatch):
    """200 trees take over a thousand passes; none may cost a planned query and a shuffle."""
    rows = spark.range(4000).selectExpr("id", "(id * 7919) % 1000 / 10.0 AS x", "((id * 7919) % 1000 > 600) = (id % 5 < 4) AS label")
    for name, value in (("BLOCK_ROWS", 100), ("TASK_ROWS", 500)):
        monkeypatch.setattr(boosting, name, value)
    context, jobs = spark.sparkContext, []
    for trees in (3, 8):
        context.setJobGroup(f"fit-{trees}", "")
        model = boosting.fit(rows, ["x"], [], "label", trees=trees, leaves=4, max_depth=2)
        assert all(tree.left[0] > 0 for tree in model.trees)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit-{trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 5 * 2  # two levels a tree


def test_fit_without_rows_or_of_one_class(spark):
    none = spark.createDataFrame([], "x double, label boolean")
    assert boosting.fit(none, ["x"], [], "label", trees=2).trees == []
    only = spark.createDataFrame([(float(i), True) for i in range(50)], "x double, label boolean")
    model = boosting.fit(only, ["x"], [], "label", trees=2)
    assert {r.probability > 0.5 for r in boosting.predict(model, only, ["label"]).collect()} == {True}


def test_bins_of_few_and_many_values(spark):
    rows = [(float(i % 1000), "v%d" % (i % 3)) for i in range(5000)] + [(0.0, "v0")] * 3000 + [(None, None), (float("nan"), "v1")]
    df = spark.createDataFrame(rows, "x double, t string")
    x, t = boosting.bin_cuts(df, ["x", "t"], ["t"], bins=50)
    assert t == ["v0", "v1", "v2"] and len(x) <= 50 and x == sorted(x) and x[0] > 0
    assert boosting.bin_cuts(df.limit(0), ["x", "t"], ["t"]) == [[], []]


def test_codes_of_a_million_values(spark):
    """One feature with most values: sorted over all tasks, codes without a gap."""
    rows = spark.range(1_000_000).selectExpr("concat('v', lpad(id, 7, '0')) AS a", "concat('w', id % 3) AS b")
    codes = learning.category_codes(rows, ["a", "b"]).cache()
    assert codes.count() == 1_000_003
    assert codes.filter("feature = 'a' AND code <> int(substring(value, 2))").count() == 0
    assert sorted(codes.filter("feature = 'b'").select("value", "code").collect()) == [("w0", 0), ("w1", 1), ("w2", 2)]
    coded = learning.encoded(rows.withColumn("id", F.col("a")), ["a", "b"])
    assert coded.columns == ["a", "b", "id"] and coded.filter("a <> int(substring(id, 2))").count() == 0


def test_a_fit_works_its_rows_out_once(spark, monkeypatch):
    """What comes before a fit (joins, an exact split) is not repeated for cuts, weights and blocks."""
    rows = spark.range(300).selectExpr("id", "id % 2 = 0 AS label").join(
        spark.range(300).selectExpr("id", "id * 1.0 AS x", "concat('v', id % 3) AS t"), "id")
    read, cuts = [], boosting.bin_cuts
    monkeypatch.setattr(boosting, "bin_cuts", lambda df, *a: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or cuts(df, *a))
    assert len(boosting.fit(rows, ["x", "t"], ["t"], "label", trees=2).trees) == 2
    assert len(read) == 1 and "parquet" in read[0] and "Join" not in read[0]


def test_cuts_of_numbers_and_texts_are_told_apart(spark):
    rows = [(float(i % 4) - 1, str(i % 3), None if i % 2 else float("nan"), None) for i in range(40)] + [(-0.0, "", None, None)]
    df = spark.createDataFrame(rows, "x double, t string, n double, u string")
    assert boosting.bin_cuts(df, ["t", "x", "n", "u"], ["t", "u"]) == [["0", "1", "2"], [0.0, 1.0, 2.0], [], []]
