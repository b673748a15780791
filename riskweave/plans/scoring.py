"""Registered scoring queries, batch and stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.scalars import as_payload, clamp, preview, rounded, stripped, title_case
from riskweave.operators import scoring
from riskweave.plans.role_sql import sql_category, sql_round, with_roles
from riskweave.session import scratch_dir
from riskweave.sources import roles
from riskweave.sources.tables import append_by_date, audited_write, stream_table
from riskweave.streaming.scoring import capture

_KEYS = ["policyholder_id", "line_number", "part_id"]


def m14_rule_score(spark, folder):
    return scoring.score_by_rules(roles.line_claims(spark, folder))\
        .select(*_KEYS, "fraud_score", "risk_category")


def m15_risk_factors(spark, folder):
    scored = scoring.score_by_rules(roles.line_claims(spark, folder))
    return scoring.explode_factors(scored, *_KEYS)


def _answers(spark, folder):
    """Requests with a model answer made from the event: an object with a score, one with
    factors, a bare list value, an empty answer, or text that is no answer."""
    value = F.col("provider_flagged_pct").cast("string")
    days = F.col("processing_days")
    answer = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('[{"fraud_score": '), value, F.lit("}]")))
        .when(F.col("event_type") == "click", F.concat(
            F.lit('[{"score": '), days.cast("string"), F.lit(', "risk_factors": [{"factor": "Model"}]}]')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("["), value, F.lit("]")))
        .when(F.col("event_type") == "signup", F.when(days % 3 == 0, "[]").when(days % 3 == 1, "0").otherwise("[{}]"))
        .when(days % 2 == 0, "not an answer")
    )
    return roles.requests(spark, folder).withColumn("predictions", answer)


def m16_model_answers(spark, folder):
    scored = scoring.score_by_model_answer(_answers(spark, folder), "predictions")
    first = F.try_element_at("risk_factors", F.lit(1))
    return scored.select("request_id", "score_source", "fraud_score", "risk_category",
                         F.size("risk_factors").alias("factor_count"),
                         first["impact"].alias("first_impact"))


def m17_fallback(spark, folder):
    model = F.when(F.col("event_type").isin("view", "click"), F.col("provider_flagged_pct") / 4)
    scored = scoring.with_fallback(roles.requests(spark, folder).withColumn("model_score", model), "model_score")
    return scored.select("request_id", "score_source", "fraud_score", "risk_category")


def p05_score_category(spark, folder):
    return roles.order_scores(spark, folder)


def p10_clamped(spark, folder):
    return roles.requests(spark, folder).select(
        "request_id", clamp(F.col("provider_flagged_pct"), 0.0, 80.0).alias("pct"),
        clamp(F.col("processing_days"), 1, 90).cast("long").alias("days"))


def p16_refused(spark, folder):
    return scoring.rejected(roles.requests(spark, folder)).select(
        "request_id", F.array_join("problems", "; ").alias("reasons"))


def p16_accepted(spark, folder):
    return scoring.accepted(roles.requests(spark, folder)).select("request_id")


def p17_casts(spark, folder):
    return roles.requests(spark, folder).select(
        F.col("request_id").cast("string").alias("id_text"),
        F.col("provider_flagged_pct").cast("int").alias("pct_whole"),
        (F.col("event_type") == "error").cast("int").alias("is_error"))


def s11_captured_scores(spark, folder):
    """Scored requests appended to a table partitioned by request date, then read back."""
    path = scratch_dir(spark, "captured")
    scored = scoring.score_by_rules(scoring.accepted(roles.requests(spark, folder)))\
        .withColumn("request_date", F.to_date("requested_at"))
    append_by_date(scored, path, "request_date")
    return spark.read.parquet(path).select("request_id", "fraud_score", "risk_category", "request_date")


def s05_write_audit(spark, folder):
    """Write tables, read them again and compare the counts."""
    sources = {"claims": roles.order_claims(spark, folder), "scores": roles.order_scores(spark, folder),
               "providers": roles.customer_providers(spark, folder)}
    return audited_write(sources, scratch_dir(spark, "audit"))


def t2_scored_stream(spark, folder):
    """Requests read as a stream, scored and captured; then the captured table."""
    stream = stream_table(spark, folder, "events")
    base = scratch_dir(spark, "stream")
    capture(roles.requests_from(stream), f"{base}/scores", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/scores").select(
        "request_id", "fraud_score", "risk_category", F.size("risk_factors").alias("factor_count"),
        "claim_amount_hkd")


def scalar_titles(spark, folder):
    return roles.incidents(spark, folder).groupBy(title_case(F.col("incident_type")).alias("title"))\
        .agg(F.count("*").alias("incident_count"))


def scalar_payload(spark, folder):
    """Request columns as JSON text, and one field read back from it."""
    body = as_payload(F.col("claim_type"), F.col("submission_channel"), F.col("processing_days"))
    return roles.line_claims(spark, folder).groupBy(body.alias("payload"))\
        .agg(F.count("*").alias("claim_count"))\
        .withColumn("channel", F.get_json_object("payload", "$.submission_channel"))


def scalar_stripped_previews(spark, folder):
    return roles.sections(spark, folder).select(
        "section_number", preview(stripped(F.col("section_content")), V.PREVIEW_LENGTH).alias("preview"))


def scalar_rounding(spark, folder):
    amount = F.col("claim_amount_hkd") / 7
    return roles.order_claims(spark, folder).select(
        "claim_id", *[rounded(amount, d).alias(f"rounded_{d}") for d in range(5)])


QUERIES = {
    "m14_rule_score": m14_rule_score,
    "m15_risk_factors": m15_risk_factors,
    "m16_model_answers": m16_model_answers,
    "m17_fallback": m17_fallback,
    "p05_score_category": p05_score_category,
    "p10_clamped": p10_clamped,
    "p16_refused": p16_refused,
    "p16_accepted": p16_accepted,
    "p17_casts": p17_casts,
    "s05_write_audit": s05_write_audit,
    "s11_captured_scores": s11_captured_scores,
    "t2_scored_stream": t2_scored_stream,
    "scalar_titles": scalar_titles,
    "scalar_payload": scalar_payload,
    "scalar_stripped_previews": scalar_stripped_previews,
    "scalar_rounding": scalar_rounding,
}

RULE_SCORE_SQL = """least(100.0::double, greatest(0.0::double, 10.0::double
    + CASE WHEN claim_amount_hkd > 500000 THEN 30 WHEN claim_amount_hkd > 200000 THEN 20
           WHEN claim_amount_hkd > 100000 THEN 10 ELSE 0 END
    + CASE WHEN provider_flagged_pct > 50 THEN 25 WHEN provider_flagged_pct > 30 THEN 15
           WHEN provider_flagged_pct > 15 THEN 8 ELSE 0 END
    + CASE WHEN processing_days <= 2 THEN 10 WHEN processing_days <= 5 THEN 5 ELSE 0 END
    + CASE submission_channel WHEN 'email' THEN 8 WHEN 'agent' THEN 5 ELSE 0 END
    + CASE WHEN claim_type IN ('travel', 'property') THEN 5 ELSE 0 END))"""

_AMOUNT_TEXT = "format('{:,}', cast(round_even(claim_amount_hkd, 0) as bigint))"
_FACTORS_SQL = f"""list_filter([
    CASE WHEN claim_amount_hkd > 200000 THEN {{'factor': 'High Claim Amount', 'impact': 'high', 'description':
            'Claim amount of HKD ' || {_AMOUNT_TEXT} || ' exceeds the 90th percentile threshold.'}}
         WHEN claim_amount_hkd > 100000 THEN {{'factor': 'Elevated Claim Amount', 'impact': 'medium', 'description':
            'Claim amount of HKD ' || {_AMOUNT_TEXT} || ' is above average for ' || claim_type || ' claims.'}} END,
    CASE WHEN provider_flagged_pct > 30 THEN {{'factor': 'Provider History', 'impact': 'high', 'description':
            'Provider has ' || provider_flagged_pct || '% flagged claims, significantly above the 10% baseline.'}}
         WHEN provider_flagged_pct > 15 THEN {{'factor': 'Provider Watch List', 'impact': 'medium', 'description':
            'Provider flagged claims rate (' || provider_flagged_pct || '%) is above normal range.'}} END,
    CASE WHEN processing_days <= 3 THEN {{'factor': 'Rapid Processing', 'impact': 'medium', 'description':
            'Claim processed in ' || processing_days || ' day(s) — unusually fast turnaround.'}} END,
    CASE WHEN submission_channel IN ('email', 'agent') THEN {{'factor': 'Submission Channel', 'impact': 'low', 'description':
            'Claims via ''' || submission_channel || ''' have a higher fraud incidence rate than digital channels.'}} END
    ], lambda f: f IS NOT NULL)"""
_STANDARD_SQL = """[{'factor': 'Standard Profile', 'impact': 'low', 'description':
    'No significant risk indicators detected for this claim.'}]"""
_WITH_FACTORS = f"CASE WHEN len({_FACTORS_SQL}) = 0 THEN {_STANDARD_SQL} ELSE {_FACTORS_SQL} END"

_PROBLEMS_SQL = """list_filter([
    CASE WHEN claim_type IS NULL THEN 'claim_type is required' END,
    CASE WHEN claim_amount_hkd IS NULL THEN 'claim_amount_hkd is required' END,
    CASE WHEN region IS NULL THEN 'region is required' END,
    CASE WHEN provider_type IS NULL THEN 'provider_type is required' END,
    CASE WHEN submission_channel IS NULL THEN 'submission_channel is required' END,
    CASE WHEN processing_days IS NULL THEN 'processing_days is required' END,
    CASE WHEN provider_flagged_pct IS NULL THEN 'provider_flagged_pct is required' END,
    CASE WHEN claim_amount_hkd < 0 THEN 'claim_amount_hkd below 0' END,
    CASE WHEN processing_days < 1 THEN 'processing_days below 1' END,
    CASE WHEN processing_days > 90 THEN 'processing_days above 90' END,
    CASE WHEN provider_flagged_pct < 0 THEN 'provider_flagged_pct below 0' END,
    CASE WHEN provider_flagged_pct > 80 THEN 'provider_flagged_pct above 80' END], lambda p: p IS NOT NULL)"""
_VALID_SQL = """provider_type IS NOT NULL AND claim_amount_hkd >= 0 AND processing_days BETWEEN 1 AND 90
    AND provider_flagged_pct BETWEEN 0 AND 80"""

_STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"

ORACLES = {
    "m14_rule_score": with_roles("line_claims", f"""
        SELECT policyholder_id, line_number, part_id, s AS fraud_score, {sql_category('s')} AS risk_category
        FROM (SELECT *, {RULE_SCORE_SQL} AS s FROM line_claims)"""),
    "m15_risk_factors": with_roles("line_claims", f"""
        SELECT policyholder_id, line_number, part_id, position, f.factor AS factor, f.impact AS impact,
            f.description AS description
        FROM (SELECT policyholder_id, line_number, part_id, unnest(fs) AS f,
                  cast(generate_subscripts(fs, 1) - 1 as integer) AS position
              FROM (SELECT *, {_WITH_FACTORS} AS fs FROM line_claims))"""),
    "m16_model_answers": with_roles("requests", f"""WITH scored AS (
            SELECT *, {RULE_SCORE_SQL} AS rules, {_WITH_FACTORS} AS own,
                CASE event_type WHEN 'view' THEN provider_flagged_pct WHEN 'click' THEN cast(processing_days as double)
                    WHEN 'purchase' THEN provider_flagged_pct WHEN 'signup' THEN 50.0::double END AS model,
                CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1
                    WHEN event_type = 'signup' AND processing_days % 3 = 2 THEN 0 END AS listed
            FROM requests),
        clamped AS (SELECT *, CASE WHEN model IS NOT NULL THEN least(100.0::double, greatest(0.0::double, model)) END AS m
            FROM scored)
        SELECT request_id, CASE WHEN model IS NULL THEN 'rules' ELSE 'model' END AS score_source,
            coalesce({sql_round('m', 1)}, rules) AS fraud_score, {sql_category('coalesce(m, rules)')} AS risk_category,
            cast(coalesce(listed, len(own)) as integer) AS factor_count,
            CASE WHEN listed = 0 THEN NULL WHEN listed = 1 THEN 'medium' ELSE own[1].impact END AS first_impact
        FROM clamped"""),
    "m17_fallback": with_roles("requests", f"""
        SELECT request_id, CASE WHEN m IS NULL THEN 'rules' ELSE 'model' END AS score_source,
            s AS fraud_score, {sql_category('s')} AS risk_category
        FROM (SELECT request_id, m, coalesce(CASE WHEN m IS NOT NULL THEN {sql_round('least(100.0::double, greatest(0.0::double, m))', 1)} END, rules) AS s
              FROM (SELECT request_id, {RULE_SCORE_SQL} AS rules,
                        CASE WHEN event_type IN ('view', 'click') THEN provider_flagged_pct / 4 END AS m
                    FROM requests))"""),
    "p05_score_category": with_roles("order_scores", "SELECT * FROM order_scores"),
    "p10_clamped": with_roles("requests", """
        SELECT request_id, greatest(0.0::double, least(80.0::double, provider_flagged_pct)) AS pct,
            greatest(1, least(90, processing_days)) AS days FROM requests"""),
    "p16_refused": with_roles("requests", f"""
        SELECT request_id, array_to_string({_PROBLEMS_SQL}, '; ') AS reasons FROM requests
        WHERE len({_PROBLEMS_SQL}) > 0"""),
    "p16_accepted": with_roles("requests", f"SELECT request_id FROM requests WHERE {_VALID_SQL}"),
    "p17_casts": with_roles("requests", """
        SELECT cast(request_id as varchar) AS id_text, cast(trunc(provider_flagged_pct) as integer) AS pct_whole,
            cast(event_type = 'error' as integer) AS is_error FROM requests"""),
    "s05_write_audit": """
        SELECT 'claims' AS "table", count(*) AS expected, count(*) AS actual, true AS ok FROM orders
        UNION ALL SELECT 'scores', count(*), count(*), true FROM orders
        UNION ALL SELECT 'providers', count(*), count(*), true FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "s11_captured_scores": with_roles("requests", f"""
        SELECT request_id, s AS fraud_score, {sql_category('s')} AS risk_category,
            cast(requested_at as date) AS request_date
        FROM (SELECT *, {RULE_SCORE_SQL} AS s FROM requests WHERE {_VALID_SQL})"""),
    "t2_scored_stream": with_roles("requests", f"""
        SELECT request_id, s AS fraud_score, {sql_category('s')} AS risk_category,
            cast(len(fs) as integer) AS factor_count, claim_amount_hkd
        FROM (SELECT *, {RULE_SCORE_SQL} AS s, {_WITH_FACTORS} AS fs FROM requests WHERE {_VALID_SQL})"""),
    "scalar_titles": with_roles("incidents", """
        SELECT CASE incident_type WHEN 'data_exfiltration' THEN 'Data Exfiltration' WHEN 'insider_threat' THEN 'Insider Threat'
            WHEN 'unauthorized_access' THEN 'Unauthorized Access' WHEN 'brute_force' THEN 'Brute Force'
            ELSE upper(incident_type[1]) || substring(incident_type, 2) END AS title, count(*) AS incident_count
        FROM incidents GROUP BY 1"""),
    "scalar_payload": with_roles("line_claims", """
        SELECT '{"claim_type":"' || claim_type || '","submission_channel":"' || submission_channel
            || '","processing_days":' || processing_days || '}' AS payload, count(*) AS claim_count,
            any_value(submission_channel) AS channel
        FROM line_claims GROUP BY 1"""),
    "scalar_stripped_previews": with_roles("sections", f"""
        SELECT section_number, CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '...' ELSE t END AS preview
        FROM (SELECT section_number, trim(section_content, {_STRIP}) AS t FROM sections)"""),
    "scalar_rounding": with_roles("order_claims", f"""
        SELECT claim_id, {', '.join(f"{sql_round('claim_amount_hkd / 7', d)} AS rounded_{d}" for d in range(5))}
        FROM order_claims"""),
}
