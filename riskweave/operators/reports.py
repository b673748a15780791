"""Claims and security reports.

Every function takes DataFrames with the documented column names and returns one.
Counts by a provider attribute are first summed per provider, so the join to
providers moves one row per provider instead of one per claim, and a provider with
a third of all claims costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions import risk
from riskweave.functions.scalars import (
    exact_avg, exact_sum, flagged_count, month_of, ratio, rounded,
)
from riskweave.operators.joins import with_provider, with_score


# --- building blocks ---------------------------------------------------------

def counts_by(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows; end ``order`` with a unique column. Each task keeps only k rows."""
    return df.orderBy(*order).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return counts_by(df, column, name="count").orderBy(F.desc("count"), column)


def _per_provider(claims: DataFrame, *keys: str) -> DataFrame:
    """Claims and flagged claims per provider; claims without one drop out, as they
    would in the inner join that follows."""
    return claims.filter(F.col("provider_id").isNotNull()).groupBy("provider_id", *keys).agg(
        F.count("*").alias("_claims"), flagged_count(F.col("is_flagged")).alias("_flagged"))


def with_history(providers: DataFrame, claims: DataFrame) -> DataFrame:
    """Providers with claims handled, flagged share and tier taken from their claims."""
    known = _per_provider(claims)
    pct = rounded(F.coalesce(ratio(F.col("_flagged") * 100, F.col("_claims")), F.lit(0.0)), 1)
    return (
        providers.join(known, "provider_id", "left")
        .withColumn("total_claims_handled", F.coalesce("_claims", F.lit(0)).cast("long"))
        .withColumn("flagged_claims_pct", pct)
        .withColumn("risk_tier", risk.provider_tier(F.col("flagged_claims_pct")))
        .drop("_claims", "_flagged")
    )


# --- claims ------------------------------------------------------------------

def claims_kpi(claims: DataFrame) -> DataFrame:
    total, flagged = F.count("*"), flagged_count(F.col("is_flagged"))
    return claims.agg(
        total.alias("total_claims"),
        flagged.alias("total_flagged"),
        rounded(ratio(flagged, total), 4).alias("fraud_rate"),
        rounded(exact_avg(F.col("claim_amount_hkd")), 0).alias("avg_claim_amount"),
    )


def claims_overview(claims: DataFrame, scores: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per claim that has a score and a provider."""
    scored = with_score(claims, scores, "fraud_score", "risk_category")
    return with_provider(scored, providers, "region").select(
        "claim_id", "claim_type", "claim_date", "claim_amount_hkd", "status", "is_flagged",
        "fraud_score", "risk_category", risk.area_of(F.col("region")).alias("area"))


def claims_by_month(claims: DataFrame) -> DataFrame:
    return claims.groupBy(month_of(F.col("claim_date")).alias("claim_month")).agg(
        F.count("*").alias("total_claims"),
        flagged_count(F.col("is_flagged")).alias("flagged_claims"),
    ).orderBy("claim_month")


def fraud_by_area(claims: DataFrame, providers: DataFrame) -> DataFrame:
    total, flagged = F.sum("_claims"), F.sum("_flagged")
    return (
        _per_provider(claims).join(providers.select("provider_id", "region"), "provider_id")
        .groupBy(risk.area_of(F.col("region")).alias("area"))
        .agg(total.alias("total_claims"), flagged.alias("flagged_claims"),
             rounded(ratio(flagged * 100, total), 1).alias("fraud_rate_pct"))
        .orderBy(F.desc("fraud_rate_pct"), "area")
    )


def top_providers(providers: DataFrame, k: int = 10) -> DataFrame:
    return top(providers, k, F.desc("flagged_claims_pct"), F.col("provider_id")).select(
        "provider_name", "provider_type", "region", "total_claims_handled",
        rounded(F.col("flagged_claims_pct"), 1).alias("flagged_pct"), "risk_tier")


def fraud_by_type_and_area(claims: DataFrame, providers: DataFrame) -> DataFrame:
    return (
        _per_provider(claims, "claim_type")
        .join(providers.select("provider_id", "region"), "provider_id")
        .groupBy("claim_type", risk.area_of(F.col("region")).alias("area"))
        .agg(F.sum("_flagged").alias("flagged_count"))
        .orderBy(F.desc("flagged_count"), "claim_type", "area")
    )


def fraud_indicators(claims: DataFrame) -> DataFrame:
    """How often each indicator occurs in the comma-separated lists."""
    listed = claims.filter(F.col("fraud_indicators").isNotNull() & (F.col("fraud_indicators") != ""))
    # Equal lists are few; merge them before splitting.
    lists = listed.groupBy("fraud_indicators").agg(F.count("*").alias("_n"))
    single = lists.select(F.explode(F.split("fraud_indicators", ",")).alias("_raw"), "_n")
    return single.groupBy(F.trim("_raw").alias("fraud_indicator"))\
        .agg(F.sum("_n").alias("frequency")).orderBy(F.desc("frequency"), "fraud_indicator")


def top_flagged(claims: DataFrame, scores: DataFrame, providers: DataFrame, k: int = 20) -> DataFrame:
    flagged = with_score(claims.filter("is_flagged"), scores, "fraud_score", "risk_category")
    ranked = with_provider(flagged, providers, "provider_name", "region")
    return top(ranked, k, F.desc("fraud_score"), F.col("claim_id")).select(
        "claim_id", "claim_type", "claim_date",
        rounded(F.col("claim_amount_hkd"), 0).alias("claim_amount_hkd"),
        "status", "fraud_score", "risk_category", "provider_name",
        risk.area_of(F.col("region")).alias("area"))


def overview_counts(claims: DataFrame, scores: DataFrame, providers: DataFrame, by: str) -> DataFrame:
    """Rows of the overview by one of its columns, counted per provider before the provider
    join, so the overview's rows never move by provider."""
    scored = with_score(claims, scores, "risk_category").filter(F.col("provider_id").isNotNull())
    keys = [] if by == "area" else [by]
    per_provider = scored.groupBy("provider_id", *keys).agg(F.count("claim_id").alias("_claims"))
    known = providers.select("provider_id", risk.area_of(F.col("region")).alias("area"))
    return per_provider.join(known, "provider_id").groupBy(by).agg(F.sum("_claims").alias("claim_count"))


def worst_region(claims: DataFrame, providers: DataFrame) -> DataFrame:
    rate = ratio(F.sum("_flagged"), F.sum("_claims"))
    rates = _per_provider(claims).join(providers.select("provider_id", "region"), "provider_id")\
        .groupBy("region").agg(rounded(rate, 4).alias("fraud_rate"), rate.alias("_rate"))
    return top(rates, 1, F.desc("_rate"), F.col("region")).drop("_rate")


def providers_with_most_flags(claims: DataFrame, providers: DataFrame, k: int = 10) -> DataFrame:
    flagged = claims.filter(F.col("is_flagged") & F.col("provider_id").isNotNull())
    counted = counts_by(flagged, "provider_id", name="flagged_claims")\
        .join(providers.select("provider_id", "provider_name"), "provider_id")
    return top(counted, k, F.desc("flagged_claims"), F.col("provider_id"))


def amount_by_flag(claims: DataFrame) -> DataFrame:
    return claims.groupBy("is_flagged").agg(
        rounded(exact_avg(F.col("claim_amount_hkd")), 2).alias("avg_claim_amount"))


def large_critical_claims(claims: DataFrame, scores: DataFrame, above: float = 100_000) -> DataFrame:
    critical = scores.filter(F.col("risk_category") == "critical")
    return with_score(claims.filter(F.col("claim_amount_hkd") > above), critical, "fraud_score")\
        .select("claim_id", "claim_type", "claim_date", "claim_amount_hkd", "fraud_score")


def rate_by_type(claims: DataFrame) -> DataFrame:
    total, flagged = F.count("*"), flagged_count(F.col("is_flagged"))
    return claims.groupBy("claim_type").agg(
        total.alias("total_claims"), flagged.alias("flagged_claims"),
        rounded(ratio(flagged, total), 4).alias("fraud_rate"))


def flagged_share(claims: DataFrame) -> DataFrame:
    return claims.agg(F.avg(F.col("is_flagged").cast("int").cast("double")).alias("fraud_rate"))


# --- security ----------------------------------------------------------------

def incidents_kpi(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count("*").alias("total_incidents"),
        F.count_if(F.col("status").isin(*V.KPI_OPEN_STATUSES)).alias("open_investigating"),
        F.count_if(F.col("severity") == "critical").alias("critical_incidents"),
        rounded(exact_avg(F.col("response_time_hours")), 1).alias("avg_mttr_hours"),
    )


def incident_counts(incidents: DataFrame, by: str, name: str = "incident_count", k: int | None = None) -> DataFrame:
    counted = counts_by(incidents, by, name=name).orderBy(F.desc(name), by)
    return counted if k is None else counted.limit(k)


def incidents_by_severity(incidents: DataFrame) -> DataFrame:
    return counts_by(incidents, "severity", name="incident_count")\
        .orderBy(risk.severity_rank(F.col("severity")))


def response_by_severity(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(
        rounded(exact_avg(F.col("response_time_hours")), 1).alias("avg_response_hours"),
        rounded(exact_avg(F.col("resolution_time_hours")), 1).alias("avg_resolution_hours"),
    ).orderBy(risk.severity_rank(F.col("severity")))


def alert_actions(alerts: DataFrame) -> DataFrame:
    return counts_by(alerts, "source_system", "status", name="alert_count")\
        .select("source_system", F.col("status").alias("action_taken"), "alert_count")\
        .orderBy("source_system", F.desc("alert_count"), "action_taken")


def recent_critical(incidents: DataFrame, k: int = 25) -> DataFrame:
    severe = incidents.filter(F.col("severity").isin("critical", "high"))
    return top(severe, k, F.desc("incident_date"), F.col("incident_id")).select(
        "incident_id", "incident_date", "incident_type", "severity", "status",
        "source_country", "target_system", "detection_method",
        rounded(F.col("response_time_hours"), 1).alias("response_hours"),
        rounded(F.col("resolution_time_hours"), 1).alias("resolution_hours"))


def metrics_trend(metrics: DataFrame, *columns: str) -> DataFrame:
    return metrics.select("month", *columns).orderBy("month")


def open_critical(incidents: DataFrame) -> DataFrame:
    return incidents.filter((F.col("severity") == "critical") & F.col("status").isin(*V.UNRESOLVED_STATUSES))\
        .agg(F.count("*").alias("open_critical"))


def response_for_type(incidents: DataFrame, incident_type: str) -> DataFrame:
    return incidents.filter(F.col("incident_type") == incident_type)\
        .agg(rounded(exact_avg(F.col("response_time_hours")), 2).alias("avg_response_hours"))


def last_twelve_months(incidents: DataFrame) -> DataFrame:
    newest = incidents.agg(F.max("incident_date")).scalar()
    start = month_of(F.add_months(newest, -11))
    return incidents.filter(F.col("incident_date") >= start)\
        .groupBy(month_of(F.col("incident_date")).alias("month"))\
        .agg(F.count("*").alias("incident_count")).orderBy("month")
