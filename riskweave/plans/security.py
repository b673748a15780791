"""Registered security queries, the monthly metrics and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions import risk
from riskweave.functions.scalars import month_of
from riskweave.operators import joins, metrics, month_table, reports
from riskweave.plans.role_sql import sql_avg, sql_flagged, sql_in, sql_round, with_roles
from riskweave.session import scratch_dir
from riskweave.sources import roles
from riskweave.sources.tables import local_rows


def _metrics(spark, folder):
    return metrics.monthly_metrics(roles.incidents(spark, folder), roles.alerts(spark, folder))


_MONTHS: dict[tuple[str, str], str] = {}


def _month_table(spark, folder):
    """The folder of the kept month table, built once per application and table folder."""
    place = spark.sparkContext.applicationId, folder
    if place not in _MONTHS:
        path = scratch_dir(spark, "months")
        month_table.fold_incidents(roles.incidents(spark, folder), path, 0)
        month_table.fold_alerts(roles.alerts(spark, folder), path, 0)
        _MONTHS[place] = path
    return _MONTHS[place]


def s02_local_ranks(spark, folder):
    """A list of the driver as a table, joined to the incidents it ranks."""
    ranks = local_rows(spark, list(V.SEVERITY_RANKS.items()), "severity string, place int")
    counts = roles.incidents(spark, folder).groupBy("severity").agg(F.count("incident_id").alias("incident_count"))
    return counts.join(ranks, "severity").select("place", "severity", "incident_count")


def a05_months_in_batches(spark, folder):
    """The kept table after three batches of facts, the last of them repeated."""
    path = scratch_dir(spark, "months")
    incidents, alerts = roles.incidents(spark, folder), roles.alerts(spark, folder)
    for number in (0, 1, 2, 2):
        mine = lambda column: F.pmod(F.xxhash64(column), F.lit(3)) == number  # noqa: B023, E731
        month_table.fold_incidents(incidents.filter(mine("incident_id")), path, number)
        month_table.fold_alerts(alerts.filter(mine("alert_id")), path, number)
    return month_table.metrics(spark, path)


def q09_incidents_kpi(spark, folder):
    return reports.incidents_kpi(roles.incidents(spark, folder))


def q10_incident_trend(spark, folder):
    """Three incident measures per month."""
    return month_table.trend(
        spark, _month_table(spark, folder), "total_incidents", "critical_incidents", "high_incidents")


def _incident_counts(column, name="incident_count", k=None):
    def run(spark, folder):
        return reports.incident_counts(roles.incidents(spark, folder), column, name, k)
    return run


def q12_incidents_by_severity(spark, folder):
    return reports.incidents_by_severity(roles.incidents(spark, folder))


def q16_response_trend(spark, folder):
    return month_table.trend(
        spark, _month_table(spark, folder), "avg_response_time_hours", "avg_resolution_time_hours")


def q17_response_by_severity(spark, folder):
    return reports.response_by_severity(roles.incidents(spark, folder))


def q18_alert_actions(spark, folder):
    return reports.alert_actions(roles.alerts(spark, folder))


def q19_false_positive_trend(spark, folder):
    return month_table.trend(spark, _month_table(spark, folder), "false_positive_rate_pct")


def q20_recent_critical(spark, folder):
    return reports.recent_critical(roles.incidents(spark, folder))


def a02_incident_months(spark, folder):
    return metrics.incident_months(roles.incidents(spark, folder))


def a04_alert_months(spark, folder):
    return metrics.alert_months(roles.alerts(spark, folder))


def a05_monthly_metrics(spark, folder):
    return _metrics(spark, folder)


def j04_months_full_join(spark, folder):
    months = roles.incidents(spark, folder).groupBy(month_of(F.col("incident_date")).alias("month"))\
        .agg(F.count("*").alias("incident_count"))
    others = roles.alerts(spark, folder).groupBy(month_of(F.col("alert_timestamp")).alias("month"))\
        .agg(F.count("*").alias("alert_count"))
    return months.join(others, "month", "full").orderBy("month")


def _incident_keys(spark, folder):
    return roles.incidents(spark, folder).select(
        F.col("incident_number").alias("incident_key"), "incident_type", "severity")


def j06_alerts_with_incident(spark, folder):
    """Alerts enriched with their incident. Two thirds have no link."""
    alerts = roles.alerts(spark, folder).select("alert_id", "alert_type", "linked_incident_number")
    joined = joins.left_join_sparse_key(
        alerts, _incident_keys(spark, folder), "linked_incident_number", "incident_key", "alert_id")
    return joined.select("alert_id", "alert_type", "linked_incident_number", "incident_type",
                         F.col("severity").alias("incident_severity"))


def j06_linked_alerts(spark, folder):
    alerts = roles.alerts(spark, folder).select(
        "alert_type", F.col("linked_incident_number").alias("linked_incident_id"))
    incidents = roles.incidents(spark, folder).select(F.col("incident_number").alias("incident_id"))
    return joins.linked(alerts, incidents).groupBy("alert_type").agg(F.count("*").alias("linked_alerts"))


def j06_unlinked_alerts(spark, folder):
    """Unlinked: no key, or a key no incident has."""
    alerts = roles.alerts(spark, folder).select("alert_type", "linked_incident_number")
    keys = _incident_keys(spark, folder).select("incident_key")
    without_key = alerts.filter(F.col("linked_incident_number").isNull())
    without_match = alerts.filter(F.col("linked_incident_number").isNotNull())\
        .join(keys, F.col("linked_incident_number") == F.col("incident_key"), "left_anti")
    return without_key.unionByName(without_match).groupBy("alert_type")\
        .agg(F.count("*").alias("unlinked_alerts"))


def n06_open_critical(spark, folder):
    return reports.open_critical(roles.incidents(spark, folder))


def n07_response_for_phishing(spark, folder):
    return reports.response_for_type(roles.incidents(spark, folder), "phishing")


def n09_last_twelve_months(spark, folder):
    return reports.last_twelve_months(roles.incidents(spark, folder))


def p07_severe_incidents(spark, folder):
    return roles.incidents(spark, folder).filter(F.col("severity").isin("critical", "high"))\
        .groupBy("severity", "status").agg(F.count("*").alias("incident_count"))


def p09_severity_rank(spark, folder):
    return roles.alerts(spark, folder).groupBy(
        "severity", risk.severity_rank(F.col("severity")).alias("severity_rank"))\
        .agg(F.count("*").alias("alert_count"))


def p11_report_required(spark, folder):
    draw = (F.col("incident_number") % 10).cast("double") / 10
    needed = risk.report_required(F.col("data_breach"), F.col("severity"), draw)
    return roles.incidents(spark, folder).groupBy("severity", needed.alias("report_required"))\
        .agg(F.count("*").alias("incident_count"))


def p12_false_positive_flag(spark, folder):
    return roles.alerts(spark, folder).groupBy("status", "is_false_positive")\
        .agg(F.count("*").alias("alert_count"))


def p13_breach_probability(spark, folder):
    return roles.incidents(spark, folder).groupBy(
        "incident_type", risk.breach_probability(F.col("incident_type")).alias("breach_probability"))\
        .agg(F.count("*").alias("incident_count"))


QUERIES = {
    "q09_incidents_kpi": q09_incidents_kpi,
    "q10_incident_trend": q10_incident_trend,
    "q11_incidents_by_type": _incident_counts("incident_type"),
    "q12_incidents_by_severity": q12_incidents_by_severity,
    "q13_detection_methods": _incident_counts("detection_method"),
    "q14_target_systems": _incident_counts("target_system", k=10),
    "q15_source_countries": _incident_counts("source_country", "attack_count", 10),
    "q16_response_trend": q16_response_trend,
    "q17_response_by_severity": q17_response_by_severity,
    "q18_alert_actions": q18_alert_actions,
    "q19_false_positive_trend": q19_false_positive_trend,
    "q20_recent_critical": q20_recent_critical,
    "a02_incident_months": a02_incident_months,
    "a04_alert_months": a04_alert_months,
    "a05_monthly_metrics": a05_monthly_metrics,
    "a05_months_in_batches": a05_months_in_batches,
    "s02_local_ranks": s02_local_ranks,
    "j04_months_full_join": j04_months_full_join,
    "j06_alerts_with_incident": j06_alerts_with_incident,
    "j06_linked_alerts": j06_linked_alerts,
    "j06_unlinked_alerts": j06_unlinked_alerts,
    "n06_open_critical": n06_open_critical,
    "n07_response_for_phishing": n07_response_for_phishing,
    "n08_source_countries": _incident_counts("source_country", "attack_count", 10),
    "n09_last_twelve_months": n09_last_twelve_months,
    "n10_attacked_systems": _incident_counts("target_system"),
    "p07_severe_incidents": p07_severe_incidents,
    "p09_severity_rank": p09_severity_rank,
    "p11_report_required": p11_report_required,
    "p12_false_positive_flag": p12_false_positive_flag,
    "p13_breach_probability": p13_breach_probability,
}


def _counts_sql(column, name="incident_count", k=None):
    limit = f" LIMIT {k}" if k else ""
    return with_roles("incidents", f"""
        SELECT {column}, count(*) AS {name} FROM incidents GROUP BY {column}
        ORDER BY 2 DESC, 1{limit}""")


_INCIDENT_MONTHS = f"""incident_months AS (
    SELECT cast(date_trunc('month', incident_date) as date) AS month,
        count(*) AS total_incidents,
        {sql_flagged("severity = 'critical'")} AS critical_incidents,
        {sql_flagged("severity = 'high'")} AS high_incidents,
        {sql_round(sql_avg('response_time_hours'), 2)} AS avg_response_time_hours,
        {sql_round(sql_avg('resolution_time_hours'), 2)} AS avg_resolution_time_hours,
        cast(sum(cast(financial_impact_usd as decimal(28,6))) as double) AS total_financial_impact_usd,
        {sql_flagged('data_breach')} AS data_breach_count,
        {sql_flagged('regulatory_report_required')} AS regulatory_reports_filed,
        {sql_round("cast(sum(impact_score) as double) / count(impact_score)", 2)} AS avg_impact_score,
        cast(sum(affected_records) as bigint) AS total_affected_records,
        {sql_round('quantile_cont(response_time_hours, 0.5)', 2)} AS median_response_time_hours
    FROM incidents GROUP BY 1)"""

_ALERT_MONTHS = f"""alert_months AS (
    SELECT cast(date_trunc('month', alert_timestamp) as date) AS month,
        count(*) AS total_alerts, {sql_flagged('is_false_positive')} AS false_positive_count,
        count(linked_incident_id) AS alerts_linked_to_incidents,
        {sql_round(sql_avg('confidence_score'), 3)} AS avg_confidence_score
    FROM alerts GROUP BY 1)"""


def _zero(column):
    return f"cast(coalesce({column}, 0) as bigint) AS {column}"


METRICS = f"""{_INCIDENT_MONTHS}, {_ALERT_MONTHS}, metrics AS (
    SELECT month, {', '.join(_zero(c) for c in metrics.COUNT_COLUMNS if c != 'high_severity_total')},
        cast(coalesce(critical_incidents + high_incidents, 0) as bigint) AS high_severity_total,
        avg_response_time_hours, avg_resolution_time_hours, total_financial_impact_usd,
        avg_impact_score, median_response_time_hours, avg_confidence_score,
        {sql_round("cast(false_positive_count * 100 as double) / nullif(total_alerts, 0)", 2)} AS false_positive_rate_pct,
        {sql_round("cast(alerts_linked_to_incidents * 100 as double) / nullif(total_alerts, 0)", 2)} AS alert_to_incident_rate_pct
    FROM incident_months FULL JOIN alert_months USING (month))"""


def _metrics_sql(columns):
    return with_roles("incidents alerts", f"WITH {METRICS} SELECT {columns} FROM metrics ORDER BY month")


ORACLES = {
    "q09_incidents_kpi": with_roles("incidents", f"""
        SELECT count(*) AS total_incidents,
            {sql_flagged(f"status IN {sql_in(V.KPI_OPEN_STATUSES)}")} AS open_investigating,
            {sql_flagged("severity = 'critical'")} AS critical_incidents,
            {sql_round(sql_avg('response_time_hours'), 1)} AS avg_mttr_hours
        FROM incidents"""),
    "q10_incident_trend": _metrics_sql("month, total_incidents, critical_incidents, high_incidents"),
    "q11_incidents_by_type": _counts_sql("incident_type"),
    "q12_incidents_by_severity": with_roles("incidents", """
        SELECT severity, count(*) AS incident_count FROM incidents GROUP BY severity"""),
    "q13_detection_methods": _counts_sql("detection_method"),
    "q14_target_systems": _counts_sql("target_system", k=10),
    "q15_source_countries": _counts_sql("source_country", "attack_count", 10),
    "q16_response_trend": _metrics_sql("month, avg_response_time_hours, avg_resolution_time_hours"),
    "q17_response_by_severity": with_roles("incidents", f"""
        SELECT severity, {sql_round(sql_avg('response_time_hours'), 1)} AS avg_response_hours,
            {sql_round(sql_avg('resolution_time_hours'), 1)} AS avg_resolution_hours
        FROM incidents GROUP BY severity"""),
    "q18_alert_actions": with_roles("alerts", """
        SELECT source_system, status AS action_taken, count(*) AS alert_count
        FROM alerts GROUP BY 1, 2 ORDER BY 1, 3 DESC"""),
    "q19_false_positive_trend": _metrics_sql("month, false_positive_rate_pct"),
    "q20_recent_critical": with_roles("incidents", f"""
        SELECT incident_id, incident_date, incident_type, severity, status, source_country,
            target_system, detection_method, {sql_round('response_time_hours', 1)} AS response_hours,
            {sql_round('resolution_time_hours', 1)} AS resolution_hours
        FROM incidents WHERE severity IN ('critical', 'high')
        ORDER BY incident_date DESC, incident_id LIMIT 25"""),
    "a02_incident_months": with_roles("incidents", f"WITH {_INCIDENT_MONTHS} SELECT * FROM incident_months"),
    "a04_alert_months": with_roles("alerts", f"WITH {_ALERT_MONTHS} SELECT * FROM alert_months"),
    "a05_monthly_metrics": _metrics_sql("*"),
    "a05_months_in_batches": _metrics_sql("*"),
    "s02_local_ranks": with_roles("incidents", """
        SELECT CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS place,
            severity, count(*) AS incident_count FROM incidents GROUP BY severity"""),
    "j04_months_full_join": with_roles("incidents alerts", """WITH i AS (
            SELECT cast(date_trunc('month', incident_date) as date) AS month, count(*) AS incident_count
            FROM incidents GROUP BY 1),
        a AS (SELECT cast(date_trunc('month', alert_timestamp) as date) AS month, count(*) AS alert_count
            FROM alerts GROUP BY 1)
        SELECT month, incident_count, alert_count FROM i FULL JOIN a USING (month)"""),
    "j06_alerts_with_incident": with_roles("incidents alerts", """
        SELECT a.alert_id, a.alert_type, a.linked_incident_number, i.incident_type,
            i.severity AS incident_severity
        FROM alerts a LEFT JOIN incidents i ON a.linked_incident_number = i.incident_number"""),
    "j06_linked_alerts": with_roles("incidents alerts", """
        SELECT alert_type, count(*) AS linked_alerts FROM alerts a
        WHERE EXISTS (SELECT 1 FROM incidents i WHERE i.incident_number = a.linked_incident_number)
        GROUP BY alert_type"""),
    "j06_unlinked_alerts": with_roles("incidents alerts", """
        SELECT alert_type, count(*) AS unlinked_alerts FROM alerts a
        WHERE NOT EXISTS (SELECT 1 FROM incidents i
            WHERE i.incident_number = a.linked_incident_number)
        GROUP BY alert_type"""),
    "n06_open_critical": with_roles("incidents", """
        SELECT count(*) AS open_critical FROM incidents
        WHERE severity = 'critical' AND status IN ('investigating', 'escalated')"""),
    "n07_response_for_phishing": with_roles("incidents", f"""
        SELECT {sql_round(sql_avg('response_time_hours'), 2)} AS avg_response_hours
        FROM incidents WHERE incident_type = 'phishing'"""),
    "n08_source_countries": _counts_sql("source_country", "attack_count", 10),
    "n09_last_twelve_months": with_roles("incidents", """
        SELECT cast(date_trunc('month', incident_date) as date) AS month, count(*) AS incident_count
        FROM incidents
        WHERE date_trunc('month', incident_date) >=
            (SELECT date_trunc('month', max(incident_date)) FROM incidents) - INTERVAL 11 MONTH
        GROUP BY 1"""),
    "n10_attacked_systems": _counts_sql("target_system"),
    "p07_severe_incidents": with_roles("incidents", """
        SELECT severity, status, count(*) AS incident_count FROM incidents
        WHERE severity IN ('critical', 'high') GROUP BY 1, 2"""),
    "p09_severity_rank": with_roles("alerts", """
        SELECT severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
            WHEN 'low' THEN 4 END AS severity_rank, count(*) AS alert_count
        FROM alerts GROUP BY 1, 2"""),
    "p11_report_required": with_roles("incidents", """
        SELECT severity, data_breach OR (severity = 'critical' AND incident_number % 10 < 8) AS report_required,
            count(*) AS incident_count FROM incidents GROUP BY 1, 2"""),
    "p12_false_positive_flag": with_roles("alerts", """
        SELECT status, status = 'false_positive' AS is_false_positive, count(*) AS alert_count
        FROM alerts GROUP BY 1, 2"""),
    "p13_breach_probability": with_roles("incidents", """
        SELECT incident_type, CASE WHEN incident_type IN ('data_exfiltration', 'insider_threat') THEN 0.6::double
            WHEN incident_type = 'ransomware' THEN 0.3::double ELSE 0.05::double END AS breach_probability,
            count(*) AS incident_count
        FROM incidents GROUP BY 1"""),
}
