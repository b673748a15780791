"""Registered claims queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions import risk
from riskweave.functions.scalars import at_second, days_after, default_text, dotted_quad, month_of, rounded
from riskweave.operators import joins, reports
from riskweave.plans.role_sql import (
    sql_area, sql_avg, sql_flagged, sql_in, sql_round, sql_tier, with_roles,
)
from riskweave.session import cut_lineage, scratch_dir
from riskweave.sources import roles, versions
from riskweave.sources.tables import bind_views, drop_tables, ensure_schema, overwrite_table


def _suppliers_with_history(spark, folder):
    return reports.with_history(
        roles.supplier_providers(spark, folder), roles.line_claims(spark, folder))


def q01_claims_kpi(spark, folder):
    return reports.claims_kpi(roles.line_claims(spark, folder))


def q02_claims_overview(spark, folder):
    return reports.claims_overview(
        roles.order_claims(spark, folder), roles.order_scores(spark, folder),
        roles.customer_providers(spark, folder))


def q03_claims_by_month(spark, folder):
    return reports.claims_by_month(roles.line_claims(spark, folder))


def q04_fraud_by_area(spark, folder):
    return reports.fraud_by_area(
        roles.line_claims(spark, folder), roles.supplier_providers(spark, folder))


def q05_top_providers(spark, folder):
    return reports.top_providers(_suppliers_with_history(spark, folder))


def q06_fraud_by_type_and_area(spark, folder):
    return reports.fraud_by_type_and_area(
        roles.line_claims(spark, folder), roles.supplier_providers(spark, folder))


def q07_fraud_indicators(spark, folder):
    return reports.fraud_indicators(roles.line_claims(spark, folder))


def q08_top_flagged(spark, folder):
    return reports.top_flagged(
        roles.order_claims(spark, folder), roles.order_scores(spark, folder),
        roles.customer_providers(spark, folder))


def _widget(column):
    def run(spark, folder):
        return reports.overview_counts(
            roles.order_claims(spark, folder), roles.order_scores(spark, folder),
            roles.customer_providers(spark, folder), column)
    return run


def n01_worst_region(spark, folder):
    return reports.worst_region(
        roles.line_claims(spark, folder), roles.supplier_providers(spark, folder))


def n02_providers_with_most_flags(spark, folder):
    return reports.providers_with_most_flags(
        roles.line_claims(spark, folder), roles.supplier_providers(spark, folder))


def n03_amount_by_flag(spark, folder):
    return reports.amount_by_flag(roles.line_claims(spark, folder))


def n04_large_critical_claims(spark, folder):
    return reports.large_critical_claims(
        roles.order_claims(spark, folder), roles.order_scores(spark, folder))


def n05_rate_by_type(spark, folder):
    return reports.rate_by_type(roles.line_claims(spark, folder))


def j01_claims_with_provider(spark, folder):
    return joins.with_provider(
        roles.order_claims(spark, folder), roles.customer_providers(spark, folder),
        "provider_type", "region").select("claim_id", "provider_id", "provider_type", "region")


def j02_claims_scores_providers(spark, folder):
    scored = joins.with_score(
        roles.order_claims(spark, folder), roles.order_scores(spark, folder), "fraud_score")
    return joins.with_provider(scored, roles.customer_providers(spark, folder), "provider_name")\
        .select("claim_id", "provider_name", "fraud_score")


def j03_claims_left_providers(spark, folder):
    """Every order, with its customer's attributes where the customer is known."""
    known = roles.customer_providers(spark, folder)
    return joins.with_provider(
        roles.order_claims(spark, folder), known, "provider_type", "balance_pct", how="left")\
        .select("claim_id", F.col("provider_type").alias("prov_type"), "balance_pct")


def j01_claims_hot_providers(spark, folder):
    """The same join where a few providers may hold most claims and none can be broadcast."""
    providers = roles.customer_providers(spark, folder).select("provider_id", "provider_type", "region")
    claims = roles.order_claims(spark, folder).select("claim_id", "provider_id")
    return joins.join_hot_keys(claims, providers, "provider_id").select("claim_id", "provider_id", "provider_type", "region")


def s03_table_versions(spark, folder):
    """A table replaced by one with other columns in one step; a reader of the first version keeps it."""
    path = scratch_dir(spark, "versions")
    claims = roles.order_claims(spark, folder)
    versions.replace(claims.select("claim_id", "claim_type"), path)
    first = versions.read(spark, path)
    versions.replace(claims.groupBy("claim_type", "status").agg(F.count("claim_id").alias("claim_count")), path)
    before = first.groupBy("claim_type").agg(F.count("claim_id").alias("claims_before"))
    return versions.read(spark, path).join(before, "claim_type")


def j05_provider_attributes(spark, folder):
    """Each claim's provider region, type and share, and the flag probability they give."""
    joined = joins.with_provider(
        roles.order_claims(spark, folder), roles.customer_providers(spark, folder),
        "provider_type", "region")
    return joined.select(
        "claim_id",
        rounded(risk.flag_probability(F.col("region"), F.col("provider_type"),
                                      F.col("claim_amount_hkd")), 2).alias("flag_probability"))


def j07_claims_in_list(spark, folder):
    return roles.line_claims(spark, folder)\
        .filter(F.col("claim_type").isin("travel", "property") & F.col("submission_channel").isin("email", "agent"))\
        .agg(F.count("*").alias("claim_count"))


def p01_projected(spark, folder):
    return roles.order_claims(spark, folder).select(
        "claim_id", F.col("claim_amount_hkd").alias("amount"), F.col("status").alias("action_taken"))


def p03_area_of_region(spark, folder):
    """Providers by region and the area it rolls up to."""
    return roles.customer_providers(spark, folder)\
        .groupBy("region", risk.area_of(F.col("region")).alias("area"))\
        .agg(F.count("*").alias("provider_count"))


def s01_named_table(spark, folder):
    """A table scanned by its name."""
    bind_views({"named_claims": roles.order_claims(spark, folder)})
    return spark.table("named_claims").groupBy("status", "claim_type").agg(F.count("*").alias("claim_count"))


def p04_provider_tier(spark, folder):
    return _suppliers_with_history(spark, folder).select(
        "provider_id", "total_claims_handled", "flagged_claims_pct", "risk_tier")


def p06_flagged_only(spark, folder):
    return roles.order_claims(spark, folder).filter("is_flagged").select("claim_id", "claim_amount_hkd")


def p08_not_blank(spark, folder):
    listed = roles.line_claims(spark, folder).filter(
        F.col("fraud_indicators").isNotNull() & (F.col("fraud_indicators") != ""))
    return listed.groupBy("claim_type").agg(F.count("*").alias("listed_claims"))


def p15_estimated_loss(spark, folder):
    return roles.order_claims(spark, folder).select(
        "claim_id",
        risk.estimated_loss(F.col("is_flagged"), F.col("claim_amount_hkd"), F.lit(0.75))
        .alias("estimated_loss_hkd"))


def k04_first_rows(spark, folder):
    return reports.top(roles.order_claims(spark, folder), 3, F.col("claim_id"))\
        .select("claim_id", "claim_type", "claim_amount_hkd")


def a08_value_counts(spark, folder):
    return reports.value_counts(roles.line_claims(spark, folder), "claim_type")


def a09_flagged_share(spark, folder):
    return reports.flagged_share(roles.line_claims(spark, folder)).select(
        rounded(F.col("fraud_rate"), 6).alias("fraud_rate"))


def a10_row_counts(spark, folder):
    claims = roles.line_claims(spark, folder).agg(F.count("*").alias("row_count"))
    providers = roles.supplier_providers(spark, folder).agg(F.count("*").alias("row_count"))
    return claims.select(F.lit("claims").alias("input"), "row_count")\
        .unionByName(providers.select(F.lit("providers").alias("input"), "row_count"))


def a11_latest_version(spark, folder):
    """Newest version per name. Versions are texts but compare as numbers: 10 is after 9."""
    versions = roles.sections(spark, folder).select(
        F.col("doc_id").alias("model"), F.col("section_number").cast("string").alias("version"))
    return versions.groupBy("model").agg(
        F.max_by("version", F.col("version").cast("long")).alias("latest_version"))


def s08_views_by_role(spark, folder):
    """A query pack in SQL over role names, bound to tables by views."""
    bind_views({"pack_claims": roles.line_claims(spark, folder),
                "pack_providers": roles.supplier_providers(spark, folder)})
    return spark.sql("""
        SELECT p.provider_type, count(*) AS total_claims, count_if(c.is_flagged) AS flagged_claims
        FROM (SELECT provider_id, is_flagged FROM IDENTIFIER(:claims)) c
        JOIN IDENTIFIER(:providers) p ON c.provider_id = p.provider_id
        GROUP BY p.provider_type""",
        args={"claims": "pack_claims", "providers": "pack_providers"})


def f_blank_defaults(spark, folder):
    """Null and empty texts replaced by a default."""
    return roles.line_claims(spark, folder)\
        .groupBy(default_text(F.col("fraud_indicators"), "Unknown").alias("indicators"))\
        .agg(F.count("*").alias("claim_count"))


def s03_table_replaced(spark, folder):
    """A schema made, a table written and replaced with other columns, read back, then dropped."""
    schema = f"riskweave_{uuid.uuid4().hex}"
    ensure_schema(spark, schema)
    claims = roles.order_claims(spark, folder)
    overwrite_table(claims.select("claim_id"), f"{schema}.claims")
    overwrite_table(claims.select("claim_id", "claim_type", "status"), f"{schema}.claims")
    kept = cut_lineage(spark.table(f"{schema}.claims").groupBy("claim_type", "status")
                       .agg(F.count("claim_id").alias("claim_count")))
    drop_tables(spark, [f"{schema}.claims", f"{schema}.absent"])
    spark.sql("DROP DATABASE IDENTIFIER(:name)", args={"name": schema})
    return kept


def scalar_months_filled(spark, folder):
    """Claims of every month between the first and the last, months without claims included."""
    claims = roles.order_claims(spark, folder).select("claim_id", month_of(F.col("claim_date")).alias("claim_month"))
    months = claims.agg(F.min("claim_month").alias("first"), F.max("claim_month").alias("last")).select(
        F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("claim_month"))
    per = claims.groupBy("claim_month").agg(F.count("*").alias("n"))
    return months.join(per, "claim_month", "left").select(
        "claim_month", F.coalesce("n", F.lit(0)).cast("long").alias("total_claims"))


def scalar_due_dates(spark, folder):
    """Days before and after a claim's date, a time on that day, an address of its numbers."""
    claim = F.col("claim_id")
    return roles.order_claims(spark, folder).select(
        "claim_id", days_after(F.col("claim_date"), F.col("processing_days")).alias("due_date"),
        days_after(F.col("claim_date"), -F.col("processing_days")).alias("opened_date"),
        F.unix_seconds(at_second(F.col("claim_date"), F.pmod(claim * 37, F.lit(86_400)))).alias("opened_second"),
        dotted_quad(F.lit(10), *[F.pmod(F.floor(claim / n), F.lit(256)) for n in (65_536, 256, 1)]).alias("address"))


def scalar_records(spark, folder):
    """Column names and values zipped to a record, with who asked."""
    names = F.array(F.lit("type"), F.lit("status"))
    record = F.map_from_arrays(names, F.array("claim_type", "status"))
    return roles.order_claims(spark, folder).select(
        "claim_id", record["type"].alias("claim_type"), record["status"].alias("status"),
        (F.length(F.current_user()) > 0).alias("asked_by_someone"))


QUERIES = {
    "q01_claims_kpi": q01_claims_kpi,
    "q02_claims_overview": q02_claims_overview,
    "q03_claims_by_month": q03_claims_by_month,
    "q04_fraud_by_area": q04_fraud_by_area,
    "q05_top_providers": q05_top_providers,
    "q06_fraud_by_type_and_area": q06_fraud_by_type_and_area,
    "q07_fraud_indicators": q07_fraud_indicators,
    "q08_top_flagged": q08_top_flagged,
    "w1_claims_by_area": _widget("area"),
    "w2_claims_by_type": _widget("claim_type"),
    "w3_claims_by_status": _widget("status"),
    "w4_claims_by_risk_category": _widget("risk_category"),
    "n01_worst_region": n01_worst_region,
    "n02_providers_with_most_flags": n02_providers_with_most_flags,
    "n03_amount_by_flag": n03_amount_by_flag,
    "n04_large_critical_claims": n04_large_critical_claims,
    "n05_rate_by_type": n05_rate_by_type,
    "j01_claims_with_provider": j01_claims_with_provider,
    "j01_claims_hot_providers": j01_claims_hot_providers,
    "s03_table_versions": s03_table_versions,
    "j02_claims_scores_providers": j02_claims_scores_providers,
    "j03_claims_left_providers": j03_claims_left_providers,
    "j05_provider_attributes": j05_provider_attributes,
    "j07_claims_in_list": j07_claims_in_list,
    "p01_projected": p01_projected,
    "p03_area_of_region": p03_area_of_region,
    "s01_named_table": s01_named_table,
    "p04_provider_tier": p04_provider_tier,
    "p06_flagged_only": p06_flagged_only,
    "p08_not_blank": p08_not_blank,
    "p15_estimated_loss": p15_estimated_loss,
    "k04_first_rows": k04_first_rows,
    "a08_value_counts": a08_value_counts,
    "a09_flagged_share": a09_flagged_share,
    "a10_row_counts": a10_row_counts,
    "a11_latest_version": a11_latest_version,
    "s08_views_by_role": s08_views_by_role,
    "scalar_blank_defaults": f_blank_defaults,
    "s03_table_replaced": s03_table_replaced,
    "scalar_months_filled": scalar_months_filled,
    "scalar_due_dates": scalar_due_dates,
    "scalar_records": scalar_records,
}

_HISTORY = f"""history AS (
    SELECT p.provider_id, p.provider_name, p.provider_type, p.region,
        cast(count(c.provider_id) as bigint) AS total_claims_handled,
        coalesce({sql_round("cast(" + sql_flagged('c.is_flagged') + " * 100 as double) / nullif(count(c.provider_id), 0)", 1)}, 0.0::double) AS flagged_claims_pct
    FROM supplier_providers p LEFT JOIN line_claims c ON p.provider_id = c.provider_id
    GROUP BY p.provider_id, p.provider_name, p.provider_type, p.region)"""

_OVERVIEW = f"""overview AS (
    SELECT c.claim_id, c.claim_type, c.claim_date, c.claim_amount_hkd, c.status, c.is_flagged,
        f.fraud_score, f.risk_category, {sql_area('p.region')} AS area
    FROM order_claims c JOIN order_scores f ON c.claim_id = f.claim_id
    JOIN customer_providers p ON c.provider_id = p.provider_id)"""

_ORDERS = "order_claims order_scores customer_providers"
_LINES = "line_claims supplier_providers"


def _overview_count(column):
    return with_roles(_ORDERS, f"""WITH {_OVERVIEW}
        SELECT {column}, count(claim_id) AS claim_count FROM overview GROUP BY {column}""")


ORACLES = {
    "q01_claims_kpi": with_roles("line_claims", f"""
        SELECT count(*) AS total_claims, {sql_flagged()} AS total_flagged,
            {sql_round(f"cast({sql_flagged()} as double) / count(*)", 4)} AS fraud_rate,
            {sql_round(sql_avg('claim_amount_hkd'), 0)} AS avg_claim_amount
        FROM line_claims"""),
    "q02_claims_overview": with_roles(_ORDERS, f"WITH {_OVERVIEW} SELECT * FROM overview"),
    "q03_claims_by_month": with_roles("line_claims", f"""
        SELECT cast(date_trunc('month', claim_date) as date) AS claim_month,
            count(*) AS total_claims, {sql_flagged()} AS flagged_claims
        FROM line_claims GROUP BY 1 ORDER BY 1"""),
    "q04_fraud_by_area": with_roles(_LINES, f"""
        SELECT {sql_area('p.region')} AS area, count(*) AS total_claims, {sql_flagged()} AS flagged_claims,
            {sql_round(f"cast({sql_flagged()} * 100 as double) / count(*)", 1)} AS fraud_rate_pct
        FROM line_claims c JOIN supplier_providers p ON c.provider_id = p.provider_id
        GROUP BY 1 ORDER BY fraud_rate_pct DESC"""),
    "q05_top_providers": with_roles(_LINES, f"""WITH {_HISTORY}
        SELECT provider_name, provider_type, region, total_claims_handled,
            flagged_claims_pct AS flagged_pct, {sql_tier('flagged_claims_pct')} AS risk_tier
        FROM history ORDER BY flagged_claims_pct DESC, provider_id LIMIT 10"""),
    "q06_fraud_by_type_and_area": with_roles(_LINES, f"""
        SELECT c.claim_type, {sql_area('p.region')} AS area, {sql_flagged()} AS flagged_count
        FROM line_claims c JOIN supplier_providers p ON c.provider_id = p.provider_id
        GROUP BY 1, 2 ORDER BY flagged_count DESC"""),
    "q07_fraud_indicators": with_roles("line_claims", """
        SELECT trim(indicator) AS fraud_indicator, count(*) AS frequency
        FROM (SELECT unnest(string_split(fraud_indicators, ',')) AS indicator FROM line_claims
              WHERE fraud_indicators IS NOT NULL AND fraud_indicators <> '')
        GROUP BY 1 ORDER BY 2 DESC"""),
    "q08_top_flagged": with_roles(_ORDERS, f"""
        SELECT c.claim_id, c.claim_type, c.claim_date,
            {sql_round('c.claim_amount_hkd', 0)} AS claim_amount_hkd, c.status,
            f.fraud_score, f.risk_category, p.provider_name, {sql_area('p.region')} AS area
        FROM order_claims c JOIN order_scores f ON c.claim_id = f.claim_id
        JOIN customer_providers p ON c.provider_id = p.provider_id
        WHERE c.is_flagged ORDER BY f.fraud_score DESC, c.claim_id LIMIT 20"""),
    "w1_claims_by_area": _overview_count("area"),
    "w2_claims_by_type": _overview_count("claim_type"),
    "w3_claims_by_status": _overview_count("status"),
    "w4_claims_by_risk_category": _overview_count("risk_category"),
    "n01_worst_region": with_roles(_LINES, f"""
        SELECT p.region, {sql_round(f"cast({sql_flagged()} as double) / count(*)", 4)} AS fraud_rate
        FROM line_claims c JOIN supplier_providers p ON c.provider_id = p.provider_id
        GROUP BY p.region ORDER BY cast({sql_flagged()} as double) / count(*) DESC, p.region LIMIT 1"""),
    "n02_providers_with_most_flags": with_roles(_LINES, """
        SELECT c.provider_id, p.provider_name, count(*) AS flagged_claims
        FROM line_claims c JOIN supplier_providers p ON c.provider_id = p.provider_id
        WHERE c.is_flagged GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10"""),
    "n03_amount_by_flag": with_roles("line_claims", f"""
        SELECT is_flagged, {sql_round(sql_avg('claim_amount_hkd'), 2)} AS avg_claim_amount
        FROM line_claims GROUP BY is_flagged"""),
    "n04_large_critical_claims": with_roles(_ORDERS, """
        SELECT c.claim_id, c.claim_type, c.claim_date, c.claim_amount_hkd, f.fraud_score
        FROM order_claims c JOIN order_scores f ON c.claim_id = f.claim_id
        WHERE f.risk_category = 'critical' AND c.claim_amount_hkd > 100000"""),
    "n05_rate_by_type": with_roles("line_claims", f"""
        SELECT claim_type, count(*) AS total_claims, {sql_flagged()} AS flagged_claims,
            {sql_round(f"cast({sql_flagged()} as double) / count(*)", 4)} AS fraud_rate
        FROM line_claims GROUP BY claim_type"""),
    "j01_claims_with_provider": with_roles(_ORDERS, """
        SELECT c.claim_id, c.provider_id, p.provider_type, p.region
        FROM order_claims c JOIN customer_providers p ON c.provider_id = p.provider_id"""),
    "j01_claims_hot_providers": with_roles(_ORDERS, """
        SELECT c.claim_id, c.provider_id, p.provider_type, p.region
        FROM order_claims c JOIN customer_providers p ON c.provider_id = p.provider_id"""),
    "s03_table_versions": with_roles("order_claims", """
        SELECT claim_type, status, count(*) AS claim_count,
            cast(sum(count(*)) OVER (PARTITION BY claim_type) as bigint) AS claims_before
        FROM order_claims GROUP BY claim_type, status"""),
    "j02_claims_scores_providers": with_roles(_ORDERS, """
        SELECT c.claim_id, p.provider_name, f.fraud_score
        FROM order_claims c JOIN order_scores f ON c.claim_id = f.claim_id
        JOIN customer_providers p ON c.provider_id = p.provider_id"""),
    "j03_claims_left_providers": with_roles(_ORDERS, """
        SELECT c.claim_id, p.provider_type AS prov_type, p.balance_pct
        FROM order_claims c LEFT JOIN customer_providers p
            ON c.provider_id = p.provider_id"""),
    "j05_provider_attributes": with_roles(_ORDERS, f"""
        SELECT c.claim_id, {sql_round(f'''
            CASE WHEN p.provider_type IN {sql_in(V.RISKY_PROVIDER_TYPES)} THEN greatest(0.25::double, base) ELSE base END
            + CASE WHEN c.claim_amount_hkd > 200000 THEN 0.10::double ELSE 0.0::double END''', 2)} AS flag_probability
        FROM order_claims c JOIN (SELECT *, CASE WHEN region IN {sql_in(V.MACAU_DISTRICTS)}
            THEN 0.30::double ELSE 0.08::double END AS base FROM customer_providers) p
            ON c.provider_id = p.provider_id"""),
    "j07_claims_in_list": with_roles("line_claims", """
        SELECT count(*) AS claim_count FROM line_claims
        WHERE claim_type IN ('travel', 'property') AND submission_channel IN ('email', 'agent')"""),
    "p01_projected": with_roles("order_claims", """
        SELECT claim_id, claim_amount_hkd AS amount, status AS action_taken FROM order_claims"""),
    "p03_area_of_region": with_roles("customer_providers", f"""
        SELECT region, {sql_area('region')} AS area, count(*) AS provider_count
        FROM customer_providers GROUP BY region"""),
    "s01_named_table": with_roles("order_claims", """
        SELECT status, claim_type, count(*) AS claim_count FROM order_claims GROUP BY status, claim_type"""),
    "p04_provider_tier": with_roles(_LINES, f"""WITH {_HISTORY}
        SELECT provider_id, total_claims_handled, flagged_claims_pct,
            {sql_tier('flagged_claims_pct')} AS risk_tier FROM history"""),
    "p06_flagged_only": with_roles("order_claims", """
        SELECT claim_id, claim_amount_hkd FROM order_claims WHERE is_flagged"""),
    "p08_not_blank": with_roles("line_claims", """
        SELECT claim_type, count(*) AS listed_claims FROM line_claims
        WHERE fraud_indicators IS NOT NULL AND fraud_indicators <> '' GROUP BY claim_type"""),
    "p15_estimated_loss": with_roles("order_claims", f"""
        SELECT claim_id, CASE WHEN is_flagged THEN {sql_round('claim_amount_hkd * 0.75::double', 2)}
            ELSE 0.0::double END AS estimated_loss_hkd FROM order_claims"""),
    "k04_first_rows": with_roles("order_claims", """
        SELECT claim_id, claim_type, claim_amount_hkd FROM order_claims ORDER BY claim_id LIMIT 3"""),
    "a08_value_counts": with_roles("line_claims", """
        SELECT claim_type, count(*) AS count FROM line_claims GROUP BY claim_type ORDER BY 2 DESC"""),
    "a09_flagged_share": with_roles("line_claims", f"""
        SELECT {sql_round("avg(CASE WHEN is_flagged THEN 1.0::double ELSE 0.0::double END)", 6)} AS fraud_rate
        FROM line_claims"""),
    "a10_row_counts": """
        SELECT 'claims' AS input, count(*) AS row_count FROM lineitem
        UNION ALL SELECT 'providers', count(*) FROM supplier""",
    "a11_latest_version": """
        SELECT source AS model, cast(max(doc_id) as varchar) AS latest_version
        FROM documents GROUP BY source""",
    "s08_views_by_role": with_roles(_LINES, f"""
        SELECT p.provider_type, count(*) AS total_claims, {sql_flagged()} AS flagged_claims
        FROM line_claims c JOIN supplier_providers p ON c.provider_id = p.provider_id
        GROUP BY p.provider_type"""),
    "scalar_blank_defaults": with_roles("line_claims", """
        SELECT coalesce(nullif(fraud_indicators, ''), 'Unknown') AS indicators, count(*) AS claim_count
        FROM line_claims GROUP BY 1"""),
    "s03_table_replaced": with_roles("order_claims", """
        SELECT claim_type, status, count(*) AS claim_count FROM order_claims GROUP BY claim_type, status"""),
    "scalar_months_filled": with_roles("order_claims", """
        SELECT cast(m AS date) AS claim_month, count(claim_id) AS total_claims
        FROM (SELECT unnest(generate_series(date_trunc('month', min(claim_date))::timestamp,
                max(claim_date)::timestamp, interval 1 month)) AS m FROM order_claims)
        LEFT JOIN order_claims ON date_trunc('month', claim_date)::date = cast(m AS date) GROUP BY 1"""),
    "scalar_due_dates": with_roles("order_claims", """
        SELECT claim_id, claim_date + cast(processing_days AS integer) AS due_date,
            claim_date - cast(processing_days AS integer) AS opened_date,
            cast(date_diff('day', DATE '1970-01-01', claim_date) * 86400 + (claim_id * 37) % 86400 AS bigint) AS opened_second,
            '10.' || (claim_id // 65536) % 256 || '.' || (claim_id // 256) % 256 || '.' || claim_id % 256 AS address
        FROM order_claims"""),
    "scalar_records": with_roles("order_claims", """
        SELECT claim_id, claim_type, status, true AS asked_by_someone FROM order_claims"""),
}
