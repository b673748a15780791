"""Scoring of claim requests: validation, rules, model answers and the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import risk
from riskweave.functions.scalars import clamp, rounded

FACTORS_TYPE = "array<struct<factor: string, impact: string, description: string>>"


def validated(requests: DataFrame) -> DataFrame:
    """Add ``problems``, the reasons a request is refused; empty when it is valid."""
    return requests.withColumn("problems", risk.request_problems())


def accepted(requests: DataFrame) -> DataFrame:
    return validated(requests).filter(F.size("problems") == 0).drop("problems")


def rejected(requests: DataFrame) -> DataFrame:
    return validated(requests).filter(F.size("problems") > 0)


def score_by_rules(claims: DataFrame) -> DataFrame:
    """Add fraud_score, risk_category and risk_factors. No shuffle; the score is a column of
    its own, so that it is computed once."""
    return claims.withColumn("fraud_score", risk.rule_score()).withColumns({
        "risk_category": risk.risk_category(F.col("fraud_score")),
        "risk_factors": risk.risk_factors(),
    })


def explode_factors(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per claim and factor, with the factor's position from 0."""
    return scored.select(*keys, F.posexplode("risk_factors").alias("position", "f"))\
        .select(*keys, "position", "f.factor", "f.impact", "f.description")


def _answer_score(answer: Column, keys: Column) -> Column:
    """Score text of one answer object: fraud_score, else score, else 50."""
    return (
        F.when(F.array_contains(keys, "fraud_score"), F.get_json_object(answer, "$.fraud_score"))
        .when(F.array_contains(keys, "score"), F.get_json_object(answer, "$.score"))
        .otherwise(F.lit("50"))
    )


def _answer_factors(answer: Column, keys: Column) -> Column:
    """Factors an answer object lists, gaps filled; null when they cannot be read."""
    listed = F.from_json(F.get_json_object(answer, "$.risk_factors"), FACTORS_TYPE)
    filled = F.transform(listed, lambda f: F.struct(
        F.coalesce(f["factor"], F.lit("Unknown")).alias("factor"),
        F.coalesce(f["impact"], F.lit("medium")).alias("impact"),
        F.coalesce(f["description"], F.lit("")).alias("description"),
    ))
    return F.when(F.array_contains(keys, "risk_factors"), filled)\
        .otherwise(F.from_json(F.lit("[]"), FACTORS_TYPE))


def score_by_model_answer(claims: DataFrame, predictions: str) -> DataFrame:
    """Score from a model's JSON answer; the rules take over when it is missing or unreadable.

    ``predictions`` holds a list, whose first element counts, or one bare value. An empty
    answer scores 50. ``score_source`` says who scored.
    """
    text, length, answer, keys = F.col(predictions), F.col("_length"), F.col("_answer"), F.col("_keys")
    is_object = keys.isNotNull()
    empty = (length == 0) | F.trim(text).isin("", "null", "0", "0.0", "{}", '""', "false")
    answered = (
        F.when(is_object, _answer_score(answer, keys).try_cast("double"))
        .when(length > 0, answer.try_cast("double"))
        .when(empty, F.lit(50.0))
        .otherwise(text.try_cast("double"))
    )
    # One step per parsed part, so that no part is parsed twice.
    parsed = (
        claims.withColumn("_length", F.json_array_length(text))
        .withColumn("_answer", F.when(length > 0, F.get_json_object(text, "$[0]")))
        .withColumn("_keys", F.json_object_keys(answer))
        .withColumns({"_answered": clamp(answered, 0.0, 100.0), "_rules": risk.rule_score(),
                      "_factors": F.when(is_object, _answer_factors(answer, keys))})
        .withColumn("_usable", F.col("_answered").isNotNull() & (keys.isNull() | F.col("_factors").isNotNull()))
    )
    usable = F.col("_usable")
    return (
        parsed.withColumn("_score", F.when(usable, F.col("_answered")).otherwise(F.col("_rules")))
        .withColumns({
            "score_source": F.when(usable, "model").otherwise("rules"),
            "risk_category": risk.risk_category(F.col("_score")),
            "fraud_score": rounded(F.col("_score"), 1),
            "risk_factors": F.when(usable & is_object, F.col("_factors")).otherwise(risk.risk_factors()),
        })
        .drop("_length", "_answer", "_keys", "_answered", "_rules", "_factors", "_usable", "_score")
    )


def with_fallback(claims: DataFrame, model_score: str) -> DataFrame:
    """The model's 0-100 score where there is one, the rule score elsewhere."""
    score = F.coalesce(rounded(clamp(F.col(model_score), 0.0, 100.0), 1), risk.rule_score())
    return claims.withColumns({
        "score_source": F.when(F.col(model_score).isNotNull(), "model").otherwise("rules"),
        "fraud_score": score,
    }).withColumn("risk_category", risk.risk_category(F.col("fraud_score")))
