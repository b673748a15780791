"""Feature table, encoding, split, boosted trees, evaluation and the model registry."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.scalars import ratio
from riskweave.operators import boosting
from riskweave.operators.boosting import Booster
from riskweave.operators.ranks import roc_auc, sorted_positions, stratified_split
from riskweave.session import cut_lineage
from riskweave.sources import versions

TARGET = "is_flagged"


def feature_table(claims: DataFrame, providers: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims with their provider's attributes; claims of unknown providers stay."""
    known = providers.select(
        "provider_id", F.col("provider_type").alias("prov_type"), "region",
        "flagged_claims_pct", "risk_tier")
    return claims.join(known, "provider_id", "left").select(key, *V.FEATURES, TARGET)


def _as_category(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def category_codes(features: DataFrame, columns=None) -> DataFrame:
    """(feature, value, code): codes 0, 1, 2 in text order per feature.

    One pass over the table; equal values are merged in each task. The values of all features are
    sorted over all tasks, however many one feature has.
    """
    columns = columns or V.CATEGORICAL_FEATURES
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _as_category(c).alias("value")) for c in columns])
    values = features.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    return sorted_positions(values, "feature", "value", {"code": F.lit(1)})


def encoded(features: DataFrame, columns=None) -> DataFrame:
    """Features with every category replaced by its code. The codes are joined, a feature at a
    time; Spark broadcasts those of a feature with few values."""
    columns = columns or V.CATEGORICAL_FEATURES
    codes = cut_lineage(category_codes(features, columns))
    order = features.columns
    for c in columns:
        own = codes.filter(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        features = features.withColumn("_as", _as_category(c)).join(own, F.col("_as") == F.col("_value"), "left")\
            .withColumn(c, F.col("_code")).drop("_as", "_value", "_code")
    return features.select(*order)


def feature_vectors(numeric: DataFrame) -> DataFrame:
    """Add ``features`` in fixed column order and the integer ``label``."""
    # An unmatched provider has no share; a negative value marks it.
    filled = numeric.fillna(-1.0, ["flagged_claims_pct"])
    return VectorAssembler(inputCols=V.FEATURES, outputCol="features").transform(filled)\
        .withColumn("label", F.col(TARGET).cast("int"))


def train_test(features: DataFrame, key: str = "claim_id") -> DataFrame:
    """Add ``is_test``: an exact 20 % of each class, the same rows on every run."""
    return stratified_split(features, TARGET, key, V.TEST_SHARE_PERCENT, V.SEED)


def class_weights(features: DataFrame, label: str = TARGET) -> DataFrame:
    """(label, rows, weight) with weight n / (classes * rows)."""
    counts = features.groupBy(label).agg(F.count("*").alias("rows"))
    every = Window.partitionBy(F.lit(1))
    total, classes = F.sum("rows").over(every), F.count("*").over(every)
    return counts.withColumn("weight", total.cast("double") / (classes * F.col("rows")))


def fit(train: DataFrame, trees: int = 200, leaves: int = 31, max_depth: int = 6, step: float = 0.05) -> Booster:
    """Boosted trees over the raw columns, each class with the same total weight."""
    return boosting.fit(train, V.FEATURES, V.CATEGORICAL_FEATURES, TARGET, trees, leaves, max_depth, step)


def predict(model: Booster, features: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, is_flagged, prediction, probability, model_score) with the score from 0 to 100."""
    kept = [key] + ([TARGET] if TARGET in features.columns else [])
    scored = boosting.predict(model, features, kept)
    return scored.select(*kept, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability",
                         (F.col("probability") * 100).alias("model_score"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy and both averages.

    Only the small table of (label, prediction) counts goes past the first aggregation.
    """
    confusion = df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("pred"))\
        .agg(F.count("*").alias("n"))
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hits"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("hits"), F.col("support")), zero)
    per_class = sides.select("class", "support", "hits", precision.alias("precision"), recall.alias("recall"),
                             F.coalesce(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")), zero).alias("f1"))
    measures = ["precision", "recall", "f1"]
    classes = per_class.select(F.col("class").cast("string").alias("row"), *measures, "support")
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    totals = per_class.agg(
        F.sum("support").alias("support"), accuracy.alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in measures])

    def row(name, values):
        return F.struct(F.lit(name).alias("row"), *[v.alias(m) for v, m in zip(values, measures)], F.col("support"))

    summary = totals.select(F.explode(F.array(
        row("accuracy", [F.col("accuracy")] * 3),
        row("macro avg", [F.col(f"macro_{m}") for m in measures]),
        row("weighted avg", [F.col(f"weighted_{m}") for m in measures]))).alias("r")).select("r.*")
    return classes.unionByName(summary)


def run_metrics(predictions: DataFrame, run: str, parameters: dict) -> DataFrame:
    """(run, name, value) rows: the test AUC and the parameters of a run."""
    auc = roc_auc(predictions.withColumn("label", F.col(TARGET).cast("int")), "label", "probability")
    given = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in parameters.items()])
    rows = F.concat(F.array(F.struct(F.lit("test_auc").alias("name"), F.col("auc").alias("value"))), given)
    return auc.select(F.lit(run).alias("run"), F.explode(rows).alias("m")).select("run", "m.name", "m.value")


def register_run(metrics: DataFrame, path: str) -> int:
    """Append a run's (run, name, value) rows with the user and the time; returns the version,
    which no other run gets, also if many register at once."""
    return versions.append(metrics.withColumns({"user": F.current_user(), "registered_at": F.current_timestamp()}), path)


def registered_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs: version, run, user, registered_at, name, value."""
    return versions.read_appended(spark, path).select("version", "run", "user", "registered_at", "name", "value")


def set_alias(spark: SparkSession, path: str, alias: str, version: int) -> None:
    """Point an alias at a registered version; the pointers are a versioned table of their own."""
    if str(version) not in versions.latest(spark, path)[1]:
        raise ValueError(f"no run has version {version}")
    versions.append(spark.createDataFrame([(alias, version)], "alias string, version long"), f"{path}/aliases")


def aliased(spark: SparkSession, path: str) -> DataFrame:
    """alias and the version it points at now."""
    set_ = versions.read_appended(spark, f"{path}/aliases", "_set")
    return set_.groupBy("alias").agg(F.max_by("version", "_set").alias("version"))


def signature(model: Booster, rows: DataFrame) -> dict[str, list[dict]]:
    """Name and type of the model's inputs and of the class it predicts, and whether each has a value
    in all of these rows; the model predicts all of them, in one pass."""
    predicted = boosting.predict(model, rows, model.features)\
        .withColumn("prediction", (F.col("probability") > 0.5).cast("int")).drop("probability")
    nulls = predicted.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in predicted.columns]).first()
    columns = [{"name": c, "type": kind, "required": nulls[c] == 0} for c, kind in predicted.dtypes]
    return {"inputs": columns[:-1], "outputs": columns[-1:]}


def save_model(spark: SparkSession, model: Booster, train: DataFrame, path: str, key: str = "claim_id",
               registry: str | None = None, name: str = "model") -> int | None:
    """Save the model and, beside it, its signature over the training rows and their first three by
    key as an example. With a registry it becomes a new version there, which is returned."""
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    seen = json.dumps(signature(model, train))
    spark.createDataFrame([(seen,)], "signature string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    first = train.orderBy(key, *model.features).limit(3).select(*model.features)
    first.coalesce(1).write.mode("overwrite").json(f"{path}/example")
    if registry is None:
        return None
    saved = spark.createDataFrame([(name, path)], "model string, folder string")
    return versions.append(saved.withColumns({"user": F.current_user(), "registered_at": F.current_timestamp()}), registry)


def load_model(path: str) -> Booster:
    return Booster.from_json(SparkSession.getActiveSession().read.text(f"{path}/model", wholetext=True).first()[0])


def saved_signature(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    return json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0])


def saved_example(spark: SparkSession, path: str) -> DataFrame:
    """The saved training rows, typed by the signature."""
    kinds = ", ".join(f"`{c['name']}` {c['type']}" for c in saved_signature(spark, path)["inputs"])
    return spark.read.schema(kinds).json(f"{path}/example")


def registered_model(spark: SparkSession, registry: str, alias: str = "champion") -> str:
    """The folder of the registered model that the alias points at."""
    pointed = aliased(spark, registry).filter(F.col("alias") == alias)
    return versions.read_appended(spark, registry).join(pointed, "version").first()["folder"]


def champions(versions: DataFrame, name: str = "model", version: str = "version") -> DataFrame:
    """(model, alias, version): the numerically newest version of every model."""
    return versions.groupBy(name).agg(F.max_by(version, F.col(version).cast("long")).alias("version"))\
        .select(name, F.lit("champion").alias("alias"), "version")
