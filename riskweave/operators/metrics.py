"""Monthly security metrics: one row per month from incidents and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import exact_avg, exact_sum, month_of, ratio, rounded
from riskweave.operators.ranks import exact_median


def incident_months(incidents: DataFrame) -> DataFrame:
    """Eleven measures per incident month."""
    dated = incidents.withColumn("month", month_of(F.col("incident_date")))
    severity = F.col("severity")
    sums = dated.groupBy("month").agg(
        F.count("incident_id").alias("total_incidents"),
        F.count_if(severity == "critical").alias("critical_incidents"),
        F.count_if(severity == "high").alias("high_incidents"),
        rounded(exact_avg(F.col("response_time_hours")), 2).alias("avg_response_time_hours"),
        rounded(exact_avg(F.col("resolution_time_hours")), 2).alias("avg_resolution_time_hours"),
        exact_sum(F.col("financial_impact_usd")).alias("total_financial_impact_usd"),
        F.count_if("data_breach").alias("data_breach_count"),
        F.count_if("regulatory_report_required").alias("regulatory_reports_filed"),
        rounded(F.sum("impact_score").cast("double") / F.count("impact_score"), 2).alias("avg_impact_score"),
        F.sum("affected_records").alias("total_affected_records"),
    )
    median = exact_median(dated, ["month"], "response_time_hours", "_median")
    return sums.join(median, "month", "left")\
        .withColumn("median_response_time_hours", rounded(F.col("_median"), 2)).drop("_median")


def alert_months(alerts: DataFrame) -> DataFrame:
    """Four measures per alert month."""
    return alerts.groupBy(month_of(F.col("alert_timestamp")).alias("month")).agg(
        F.count("alert_id").alias("total_alerts"),
        F.count_if("is_false_positive").alias("false_positive_count"),
        F.count("linked_incident_id").alias("alerts_linked_to_incidents"),
        rounded(exact_avg(F.col("confidence_score")), 3).alias("avg_confidence_score"),
    )


COUNT_COLUMNS = [
    "total_incidents", "critical_incidents", "high_incidents", "data_breach_count",
    "regulatory_reports_filed", "total_affected_records", "total_alerts",
    "false_positive_count", "alerts_linked_to_incidents", "high_severity_total",
]


def combine_months(incident_side: DataFrame, alert_side: DataFrame) -> DataFrame:
    """Full outer join by month. A month missing on one side counts zero there and has
    no means or rates."""
    both = incident_side.join(alert_side, "month", "full")\
        .withColumn("high_severity_total", F.col("critical_incidents") + F.col("high_incidents"))
    counted = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in COUNT_COLUMNS})

    def pct(column: str):
        return rounded(ratio(F.col(column) * 100, F.col("total_alerts")), 2)

    return counted.withColumns({
        "false_positive_rate_pct": pct("false_positive_count"),
        "alert_to_incident_rate_pct": pct("alerts_linked_to_incidents"),
    }).orderBy("month")


def monthly_metrics(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    return combine_months(incident_months(incidents), alert_months(alerts))
