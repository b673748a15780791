"""Registered learning queries and their SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions import risk
from riskweave.functions.scalars import clamp
from riskweave.operators import boosting, learning, ranks
from riskweave.plans.role_sql import sql_tier, with_roles
from riskweave.plans.scoring import RULE_SCORE_SQL
from riskweave.session import scratch_dir
from riskweave.sources import roles

TREES = 200
#: Held-out AUC that the model reaches on the given tables.
LEAST_AUC = 0.75


def _features(spark, folder):
    pct = clamp(F.col("balance_pct"), 0.0, 80.0)
    providers = roles.customer_providers(spark, folder).withColumns({
        "flagged_claims_pct": pct, "risk_tier": risk.provider_tier(pct)})
    return learning.feature_table(roles.order_claims(spark, folder), providers)


def m01_feature_table(spark, folder):
    return _features(spark, folder)


def m02_category_codes(spark, folder):
    return learning.category_codes(_features(spark, folder))


def m03_feature_vectors(spark, folder):
    """The assembled vector, unpacked again to columns in its fixed order."""
    vectors = learning.feature_vectors(learning.encoded(_features(spark, folder)))
    values = vectors.withColumn("_v", vector_to_array("features"))
    return values.select("claim_id", "label", *[F.col("_v")[i].alias(f"f{i}") for i in range(len(V.FEATURES))])


def v03_train_test_split(spark, folder):
    return learning.train_test(_features(spark, folder)).select("claim_id", "is_flagged", "is_test")


def m05_class_weights(spark, folder):
    return learning.class_weights(_features(spark, folder))


_SAVED: dict[tuple[str, str], str] = {}


def _train_rows(spark, folder):
    return learning.train_test(_features(spark, folder)).filter(~F.col("is_test"))


def _saved(spark, folder):
    """The folder of the champion model, trained once per application and table folder, saved and registered."""
    place = spark.sparkContext.applicationId, folder
    if place not in _SAVED:
        models, train = scratch_dir(spark, "models"), _train_rows(spark, folder)
        version = learning.save_model(spark, learning.fit(train, trees=TREES), train, scratch_dir(spark, "model"), registry=models)
        learning.set_alias(spark, models, "champion", version)
        _SAVED[place] = learning.registered_model(spark, models)
    return _SAVED[place]


def _fitted(spark, folder):
    return learning.load_model(_saved(spark, folder))


def m06_root_histogram(spark, folder):
    """The first tree's sums at its root: training rows and flagged ones by feature and bin."""
    train = _train_rows(spark, folder).filter("is_flagged IS NOT NULL")
    cuts = boosting.bin_cuts(train, V.FEATURES, V.CATEGORICAL_FEATURES)
    return boosting.root_histogram(boosting.Booster(V.FEATURES, V.CATEGORICAL_FEATURES, cuts), train, "is_flagged")


def _test_rows(spark, folder):
    return learning.train_test(_features(spark, folder)).filter("is_test")


def m07_predictions(spark, folder):
    return learning.predict(_fitted(spark, folder), _test_rows(spark, folder))\
        .select("claim_id", "is_flagged", "prediction", "probability")


def _registered(spark, folder):
    """Two runs, on held-out and on all claims, registered one after the other."""
    model, runs = _fitted(spark, folder), scratch_dir(spark, "runs")
    for run, rows in (("held_out", _test_rows(spark, folder)), ("all_claims", _features(spark, folder))):
        version = learning.register_run(learning.run_metrics(learning.predict(model, rows), run, {
            "trees": TREES, "max_depth": 6, "leaves": 31, "learning_rate": 0.05, "test_percent": V.TEST_SHARE_PERCENT}), runs)
        learning.set_alias(spark, runs, "champion", version)
    return runs


def m10_run_metrics(spark, folder):
    """Two runs' AUC and parameters, registered in one table of runs and read back."""
    return learning.registered_runs(spark, _registered(spark, folder)).select("run", "name", "value")


def m07_prediction_properties(spark, folder):
    """Whether each held-out claim's probability is one and its class the more probable."""
    sound = F.col("probability").between(0, 1) & (F.col("prediction") == (F.col("probability") > 0.5).cast("int"))
    return m07_predictions(spark, folder).select("claim_id", "is_flagged", sound.alias("sound"))


def m10_run_properties(spark, folder):
    """Every run's version, parameters and alias, whether its AUC is within bounds and its user the current one."""
    path = _registered(spark, folder)
    ok = F.when(F.col("name") == "test_auc", F.col("value").between(LEAST_AUC, 1))
    return learning.registered_runs(spark, path).join(learning.aliased(spark, path), "version", "left").select(
        "version", "run", "alias", "name", F.when(F.col("name") != "test_auc", F.col("value")).alias("value"),
        ok.alias("within"), (F.col("user") == F.current_user()).alias("own"))


def m13_saved_model_scores(spark, folder):
    """Load the saved model and score every claim with raw columns."""
    features = _features(spark, folder)
    scored = learning.predict(learning.load_model(_saved(spark, folder)), features.drop("is_flagged"))
    return scored.select("claim_id", F.round("model_score", 1).alias("fraud_score"),
                         risk.risk_category(F.col("model_score")).alias("risk_category"))


def _described(spark, folder):
    """Whether the saved signature is that of the raw columns and a class, and the model, as loaded,
    scores its example rows as it says."""
    path, features = _saved(spark, folder), _features(spark, folder)
    seen, example = learning.saved_signature(spark, path), learning.saved_example(spark, path)
    inputs = [(c["name"], c["type"]) for c in seen["inputs"]] == features.select(*V.FEATURES).dtypes
    outputs = [(c["name"], c["type"]) for c in seen["outputs"]] == [("prediction", "int")]
    scored = learning.predict(learning.load_model(path), example.withColumn("claim_id", F.lit(0))).collect()
    rows = _train_rows(spark, folder).limit(3).count()
    return inputs and outputs and len(scored) == rows and all(r.prediction == int(r.probability > 0.5) for r in scored)


def m13_score_properties(spark, folder):
    """Whether each claim's score has one decimal and lies between 0 and 100 and its category is
    one that such a score can have; and whether the model's signature and example rows are sound."""
    scored, described = m13_saved_model_scores(spark, folder), _described(spark, folder)
    near = F.col("fraud_score")
    fits = (F.col("risk_category") == risk.risk_category(near - 0.05)) | (F.col("risk_category") == risk.risk_category(near + 0.05))
    return scored.select("claim_id", (near.between(0, 100) & (F.round(near, 1) == near) & fits & F.lit(described)).alias("sound"))


def _rule_predictions(spark, folder):
    return roles.line_claims(spark, folder).select(
        F.col("is_flagged").cast("int").alias("label"), risk.rule_score().alias("score"))


def v04_roc_auc(spark, folder):
    """How well the rule score ranks flagged lines; heavy ties."""
    return ranks.roc_auc(_rule_predictions(spark, folder), "label", "score")\
        .select("positives", "negatives", F.round("auc", 9).alias("auc"))


def m08_amount_auc(spark, folder):
    """The same for the amount: nearly every value differs."""
    claims = roles.order_claims(spark, folder).select(
        F.col("is_flagged").cast("int").alias("label"), "claim_amount_hkd")
    return ranks.roc_auc(claims, "label", "claim_amount_hkd")\
        .select("positives", "negatives", F.round("auc", 9).alias("auc"))


def m09_classification_report(spark, folder):
    judged = _rule_predictions(spark, folder).withColumn("prediction", (F.col("score") >= 50).cast("int"))
    report = learning.classification_report(judged, "label", "prediction")
    return report.select("row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def m12_champions(spark, folder):
    versions = roles.sections(spark, folder).select(
        F.col("doc_type").alias("model"), F.col("section_number").cast("string").alias("version"))
    return learning.champions(versions)


QUERIES = {f.__name__: f for f in [
    m01_feature_table, m02_category_codes, m03_feature_vectors, v03_train_test_split, m05_class_weights,
    m06_root_histogram, m07_predictions, m07_prediction_properties, m10_run_metrics, m10_run_properties,
    m13_saved_model_scores, m13_score_properties, v04_roc_auc, m08_amount_auc,
    m09_classification_report, m12_champions,
]}

_ORDERS = "order_claims customer_providers"
_FEATURES = f"""features AS (
    SELECT c.claim_id, c.claim_amount_hkd, c.processing_days, c.claim_type, p.provider_type AS prov_type, p.region,
        c.submission_channel, p.pct AS flagged_claims_pct, {sql_tier('p.pct')} AS risk_tier, c.is_flagged
    FROM order_claims c LEFT JOIN (
        SELECT *, greatest(0.0::double, least(80.0::double, balance_pct)) AS pct FROM customer_providers) p
        ON c.provider_id = p.provider_id)"""
_CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS value, dense_rank() OVER (ORDER BY {c}) - 1 AS code "
    f"FROM (SELECT DISTINCT {c} FROM features)" for c in V.CATEGORICAL_FEATURES)


def _code(column: str) -> str:
    return f"cast((SELECT code FROM codes WHERE feature = '{column}' AND value = features.{column}) as double)"


def _auc_sql(source: str, score: str) -> str:
    return f"""
        SELECT cast(sum(label) as bigint) AS positives, cast(sum(1 - label) as bigint) AS negatives,
            round((sum(label * mean_rank) - sum(label)::double * (sum(label) + 1) / 2)
                / (sum(label)::double * sum(1 - label)), 9) AS auc
        FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::double AS mean_rank
              FROM ({source}))"""


_JUDGED = f"""judged AS (
    SELECT cast(is_flagged as integer) AS label, cast({RULE_SCORE_SQL} >= 50 as integer) AS prediction FROM line_claims),
per_class AS (
    SELECT class, cast(sum(cast(label = class as bigint)) as bigint) AS support,
        coalesce(sum(cast(label = class AND prediction = class as bigint))::double
            / nullif(sum(cast(prediction = class as bigint)), 0), 0) AS precision,
        coalesce(sum(cast(label = class AND prediction = class as bigint))::double
            / nullif(sum(cast(label = class as bigint)), 0), 0) AS recall
    FROM judged, (SELECT unnest([0, 1]) AS class) GROUP BY class),
scored AS (
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per_class),
overall AS (SELECT avg(cast(label = prediction as double)) AS accuracy, count(*) AS n FROM judged)"""

_HASH = "md5('42:' || claim_id)"
_SPLIT = f"""split AS (
    SELECT claim_id, is_flagged, row_number() OVER (PARTITION BY is_flagged ORDER BY {_HASH})
        <= (count(*) OVER (PARTITION BY is_flagged) * 20 + 50) // 100 AS is_test
    FROM order_claims)"""
_PAIRS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, null::double AS number, coalesce({c}, 'None') AS text, is_flagged FROM train"
    if c in V.CATEGORICAL_FEATURES else
    f"SELECT '{c}' AS feature, {c}::double AS number, null AS text, is_flagged FROM train WHERE {c} IS NOT NULL" for c in V.FEATURES)

ORACLES = {
    "m01_feature_table": with_roles(_ORDERS, f"WITH {_FEATURES} SELECT * FROM features"),
    "m02_category_codes": with_roles(_ORDERS, f"WITH {_FEATURES} {_CODES}"),
    "m03_feature_vectors": with_roles(_ORDERS, f"""WITH {_FEATURES}, codes AS ({_CODES})
        SELECT claim_id, cast(is_flagged as integer) AS label, claim_amount_hkd AS f0,
            cast(processing_days as double) AS f1, {_code('claim_type')} AS f2, {_code('prov_type')} AS f3,
            {_code('region')} AS f4, {_code('submission_channel')} AS f5, flagged_claims_pct AS f6,
            {_code('risk_tier')} AS f7 FROM features"""),
    "v03_train_test_split": with_roles("order_claims", f"""
        SELECT claim_id, is_flagged, row_number() OVER (PARTITION BY is_flagged ORDER BY {_HASH})
            <= (count(*) OVER (PARTITION BY is_flagged) * 20 + 50) // 100 AS is_test
        FROM order_claims"""),
    "m05_class_weights": with_roles("order_claims", """
        SELECT is_flagged, count(*) AS rows,
            cast(sum(count(*)) OVER () as double) / (count(*) OVER () * count(*)) AS weight
        FROM order_claims GROUP BY is_flagged"""),
    "v04_roc_auc": with_roles("line_claims", _auc_sql(
        f"SELECT cast(is_flagged as integer) AS label, {RULE_SCORE_SQL} AS score FROM line_claims", "score")),
    "m08_amount_auc": with_roles("order_claims", _auc_sql(
        "SELECT cast(is_flagged as integer) AS label, claim_amount_hkd FROM order_claims", "claim_amount_hkd")),
    "m09_classification_report": with_roles("line_claims", f"""WITH {_JUDGED}
        SELECT "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
            SELECT cast(class as varchar) AS "row", precision, recall, f1, support FROM scored
            UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n FROM overall
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) FROM scored
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                sum(f1 * support) / sum(support), cast(sum(support) as bigint) FROM scored)"""),
    "m06_root_histogram": with_roles(_ORDERS, f"""WITH {_FEATURES}, {_SPLIT},
        train AS (SELECT f.* FROM features f JOIN split s ON f.claim_id = s.claim_id WHERE NOT s.is_test),
        pairs AS ({_PAIRS}),
        counted AS (SELECT feature, number, text, count(*) AS n, count_if(is_flagged) AS yes FROM pairs GROUP BY ALL),
        placed AS (
            SELECT *, coalesce(sum(n) OVER before, 0) AS earlier, row_number() OVER (PARTITION BY feature ORDER BY number, text) - 1 AS place,
                count(*) OVER (PARTITION BY feature) AS size, sum(n) OVER (PARTITION BY feature) AS total
            FROM counted WINDOW before AS (PARTITION BY feature ORDER BY number, text
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        binned AS (SELECT *, CASE WHEN size <= {boosting.BINS} THEN place ELSE earlier * {boosting.BINS} // total END AS slot FROM placed)
        SELECT feature, cast(dense_rank() OVER (PARTITION BY feature ORDER BY slot) - 1 as integer) AS bin,
            cast(sum(n) as bigint) AS "rows", cast(sum(yes) as bigint) AS flagged
        FROM binned GROUP BY feature, slot"""),
    "m07_prediction_properties": with_roles("order_claims", f"""WITH {_SPLIT}
        SELECT claim_id, is_flagged, true AS sound FROM split WHERE is_test"""),
    "m10_run_properties": f"""
        SELECT version, run, alias, name, value, within, true AS own
        FROM (VALUES (0::bigint, 'held_out', null), (1::bigint, 'all_claims', 'champion')) r(version, run, alias), (VALUES
            ('test_auc', cast(null as double), true), ('trees', {TREES}.0::double, null), ('max_depth', 6.0::double, null),
            ('leaves', 31.0::double, null), ('learning_rate', 0.05::double, null),
            ('test_percent', {V.TEST_SHARE_PERCENT}.0::double, null)) m(name, value, within)""",
    "m13_score_properties": with_roles("order_claims", "SELECT claim_id, true AS sound FROM order_claims"),
    "m12_champions": """
        SELECT lang AS model, 'champion' AS alias, cast(max(doc_id) as varchar) AS version
        FROM documents GROUP BY lang""",
}
