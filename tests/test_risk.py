"""Rules at their boundaries, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions import risk
from riskweave.functions.scalars import (
    at_second, clamp, days_after, dotted_quad, is_blank, preview, rounded, stripped, title_case,
)
from riskweave.operators import scoring

CLAIM = "claim_type string, claim_amount_hkd double, submission_channel string, processing_days long, provider_flagged_pct double"


def one(spark, row, *columns, schema=CLAIM):
    return spark.createDataFrame([row], schema).select(*columns).first()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("claim, score, category", [
    (("medical", 5_000.0, "online_portal", 14, 5.0), 10.0, "low"),
    (("motor", 450_000.0, "agent", 5, 60.0), 65.0, "high"),
    (("medical", 100_000.0, "branch", 6, 15.0), 10.0, "low"),
    (("medical", 100_000.01, "branch", 6, 15.1), 28.0, "medium"),
    (("travel", 500_000.0, "email", 2, 30.0), 10 + 20 + 8 + 10 + 8 + 5.0, "high"),
    (("property", 500_000.5, "email", 2, 50.5), 88.0, "critical"),
    (("life", 200_000.0, "mobile_app", 3, 30.1), 10 + 10 + 15 + 5.0, "medium"),
])
def test_rule_score(spark, claim, score, category):
    row = one(spark, claim, risk.rule_score().alias("s"), risk.risk_category(risk.rule_score()).alias("c"))
    assert (row.s, row.c) == (score, category)


@pytest.mark.parametrize("claim, factors", [
    (("medical", 5_000.0, "online_portal", 14, 5.0), ["Standard Profile"]),
    (("medical", 200_000.0, "online_portal", 4, 15.0), ["Elevated Claim Amount"]),
    (("medical", 200_001.0, "agent", 3, 30.5),
     ["High Claim Amount", "Provider History", "Rapid Processing", "Submission Channel"]),
    (("medical", None, "branch", None, None), ["Standard Profile"]),
    (("medical", 1.0, "branch", 9, 15.5), ["Provider Watch List"]),
])
def test_risk_factors(spark, claim, factors):
    row = one(spark, claim, risk.risk_factors().alias("f"))
    assert [f.factor for f in row.f] == factors


def test_factor_texts(spark):
    row = one(spark, ("motor", 1_234_567.5, "email", 1, 35.0), risk.risk_factors().alias("f"))
    assert [f.description for f in row.f] == [
        "Claim amount of HKD 1,234,568 exceeds the 90th percentile threshold.",
        "Provider has 35.0% flagged claims, significantly above the 10% baseline.",
        "Claim processed in 1 day(s) — unusually fast turnaround.",
        "Claims via 'email' have a higher fraud incidence rate than digital channels.",
    ]


@pytest.mark.parametrize("pct, tier", [(25.0, "critical"), (24.9, "high"), (15.0, "high"), (8.0, "medium"), (7.9, "low")])
def test_provider_tier(spark, pct, tier):
    assert value(spark, risk.provider_tier(F.lit(pct))) == tier


@pytest.mark.parametrize("score, category", [(75.0, "critical"), (74.9, "high"), (50.0, "high"), (25.0, "medium"), (24.9, "low")])
def test_category(spark, score, category):
    assert value(spark, risk.risk_category(F.lit(score))) == category


@pytest.mark.parametrize("region, area", [
    ("Wan Chai", "HK Island"), ("Kwun Tong", "Kowloon"), ("North", "New Territories"),
    ("Taipa", "Macau"), ("Coloane", "Coloane"), ("Elsewhere", "Elsewhere"), (None, None)])
def test_area(spark, region, area):
    assert value(spark, risk.area_of(F.lit(region).cast("string"))) == area


@pytest.mark.parametrize("region, kind, amount, chance", [
    ("Taipa", "clinic", 1.0, 0.30), ("Taipa", "legal", 1.0, 0.30), ("North", "repair_shop", 1.0, 0.25),
    ("North", "clinic", 1.0, 0.08), ("North", "clinic", 200_000.0, 0.08), ("Coloane", "clinic", 200_001.0, 0.40)])
def test_flag_probability(spark, region, kind, amount, chance):
    got = value(spark, risk.flag_probability(F.lit(region), F.lit(kind), F.lit(amount)))
    assert got == pytest.approx(chance)


def test_severity_rank_and_breach(spark):
    assert value(spark, risk.severity_rank(F.lit("low"))) == 4
    assert value(spark, risk.severity_rank(F.lit("info"))) is None
    assert value(spark, risk.breach_probability(F.lit("ransomware"))) == 0.3
    assert value(spark, risk.breach_probability(F.lit("ddos"))) == 0.05


def test_requests_are_validated(spark):
    schema = ("claim_type string, claim_amount_hkd double, region string, provider_type string, "
              "submission_channel string, processing_days long, provider_flagged_pct double")
    rows = [("medical", 0.0, "North", "lab", "email", 1, 0.0), ("medical", 1.0, "North", "lab", "email", 90, 80.0),
            ("medical", -0.01, "North", "lab", "email", 0, 80.1), (None, 1.0, "North", "lab", "email", 91, -0.1)]
    df = spark.createDataFrame(rows, schema)
    assert scoring.accepted(df).count() == 2
    problems = [r.problems for r in scoring.rejected(df).orderBy("claim_amount_hkd").collect()]
    assert problems == [
        ["claim_amount_hkd below 0", "processing_days below 1", "provider_flagged_pct above 80"],
        ["claim_type is required", "processing_days above 90", "provider_flagged_pct below 0"]]


ANSWERS = [
    ('[{"fraud_score": 71.25}]', 71.3, "high", "model", []),
    ('[{"score": 130, "risk_factors": [{"factor": "F"}, {"impact": "low", "description": "D"}]}]', 100.0, "critical",
     "model", [("F", "medium", ""), ("Unknown", "low", "D")]),
    ('[{}]', 50.0, "high", "model", []),
    ('[12.5]', 12.5, "low", "model", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('33', 33.0, "medium", "model", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('0', 50.0, "high", "model", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('[]', 50.0, "high", "model", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('[{"fraud_score": null}]', 10.0, "low", "rules", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('[{"fraud_score": 5, "risk_factors": 7}]', 10.0, "low", "rules", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('{"fraud_score": 5}', 10.0, "low", "rules", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    ('nonsense', 10.0, "low", "rules", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
    (None, 10.0, "low", "rules", [("Standard Profile", "low", "No significant risk indicators detected for this claim.")]),
]


@pytest.mark.parametrize("answer, score, category, source, factors", ANSWERS)
def test_model_answers(spark, answer, score, category, source, factors):
    df = spark.createDataFrame([("medical", 1.0, "branch", 9, 1.0, answer)], CLAIM + ", predictions string")
    row = scoring.score_by_model_answer(df, "predictions").first()
    assert (row.fraud_score, row.risk_category, row.score_source) == (score, category, source)
    assert [tuple(f) for f in row.risk_factors] == factors


def test_scalars(spark):
    assert value(spark, rounded(F.lit(1.005), 2)) == 1.01
    assert value(spark, rounded(F.lit(0.125), 2)) == 0.13
    assert value(spark, clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert value(spark, clamp(F.lit(7.0), 0.0, 1.0)) == 1.0
    assert value(spark, title_case(F.lit("online_portal_x"))) == "Online Portal_x"
    assert value(spark, stripped(F.lit(" \t a b\n "))) == "a b"
    assert value(spark, is_blank(F.lit(" \n")))
    assert value(spark, preview(F.lit("abcdef"), 4)) == "abcd..."
    assert value(spark, preview(F.lit("abcd"), 4)) == "abcd"
    assert value(spark, dotted_quad(*[F.lit(n) for n in (1, 2, 3, 4)])) == "1.2.3.4"
    day = F.lit("2024-02-28").cast("date")
    assert str(value(spark, days_after(day, F.lit(2)))) == "2024-03-01"
    assert str(value(spark, at_second(day, F.lit(3661)))) == "2024-02-28 01:01:01"


def test_rounding_and_sums_of_large_and_fine_values(spark):
    from riskweave.functions.scalars import exact_avg, exact_sum, rounded
    df = spark.createDataFrame([(3e14,), (0.001,), (0.002,)], "x double")
    assert df.filter("x > 1").select(rounded(F.col("x"), 2)).first()[0] == 3e14
    row = df.filter("x < 1").agg(exact_sum(F.col("x")), exact_avg(F.col("x"))).first()
    assert row[0] == 0.003 and row[1] == 0.0015
