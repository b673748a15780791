"""The role bindings written as SQL, for the checking engine.

``with_roles`` puts the wanted roles in front of a query as common table expressions.
"""

from __future__ import annotations

from riskweave import fixed_values as V


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"list_extract({sql_list(values)}, cast({index} as integer) + 1)"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_area(region: str) -> str:
    whens = " ".join(f"WHEN {region} IN {sql_in(names)} THEN '{area}'" for area, names in V.AREAS.items())
    return f"CASE {whens} ELSE {region} END"


def sql_round(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(38,6)), {digits}) as double)"


def sql_avg(x: str) -> str:
    return f"(cast(sum(cast({x} as decimal(28,6))) as double) / nullif(count({x}), 0))"


def sql_flagged(flag: str = "is_flagged") -> str:
    return f"cast(coalesce(sum(CASE WHEN {flag} THEN 1 ELSE 0 END), 0) as bigint)"


def sql_category(score: str) -> str:
    return (f"CASE WHEN {score} >= 75 THEN 'critical' WHEN {score} >= 50 THEN 'high' "
            f"WHEN {score} >= 25 THEN 'medium' ELSE 'low' END")


def sql_tier(pct: str) -> str:
    return (f"CASE WHEN {pct} >= 25 THEN 'critical' WHEN {pct} >= 15 THEN 'high' "
            f"WHEN {pct} >= 8 THEN 'medium' ELSE 'low' END")


_REGION = f"coalesce(list_extract({sql_list(V.DISTRICTS)}, {{key}} + 1), n_name)"

ROLES = {
    "line_claims": f"""
        SELECT l_orderkey AS policyholder_id, l_suppkey AS provider_id,
            {sql_pick(V.CLAIM_TYPES, 'l_linenumber % 5')} AS claim_type,
            cast(l_shipdate as date) AS claim_date,
            round(l_extendedprice * 780) / 100 AS claim_amount_hkd,
            CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pending'
                 WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'under_review'
                 WHEN l_linestatus = 'O' THEN 'denied'
                 WHEN l_returnflag = 'N' THEN 'approved' ELSE 'paid' END AS status,
            {sql_pick(V.CHANNELS, 'cast(round(l_discount * 100) as integer) % 5')} AS submission_channel,
            cast(l_quantity as bigint) AS processing_days,
            (l_returnflag = 'R' AND l_quantity > 30) AS is_flagged,
            CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN nullif(concat_ws(', ',
                CASE WHEN l_discount >= 0.08::double THEN 'inflated_amount' END,
                CASE WHEN l_quantity <= 40 THEN 'rapid_succession' END,
                CASE WHEN l_tax >= 0.06::double THEN 'out_of_network' END,
                CASE WHEN l_linenumber >= 6 THEN 'multiple_policies' END), '') END AS fraud_indicators,
            round(l_tax * 1000) AS provider_flagged_pct,
            cast(l_linenumber as bigint) AS line_number, l_partkey AS part_id
        FROM lineitem""",
    "order_claims": f"""
        SELECT o_orderkey AS claim_id, o_custkey AS provider_id,
            {sql_pick(V.CLAIM_TYPES, 'cast(substring(o_orderpriority, 1, 1) as integer) - 1')} AS claim_type,
            cast(o_orderdate as date) AS claim_date, o_totalprice AS claim_amount_hkd,
            CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'paid' ELSE 'under_review' END AS status,
            {sql_pick(V.CHANNELS, 'dayofmonth(o_orderdate) % 5')} AS submission_channel,
            cast(dayofyear(o_orderdate) % 90 + 1 as bigint) AS processing_days,
            (o_orderstatus = 'P' AND o_totalprice > 350000) AS is_flagged
        FROM orders""",
    "order_scores": f"""
        SELECT o_orderkey AS claim_id, cast((o_orderkey * 7919) % 1001 as double) / 10 AS fraud_score,
            {sql_category('cast((o_orderkey * 7919) % 1001 as double) / 10')} AS risk_category
        FROM orders""",
    "supplier_providers": f"""
        SELECT s_suppkey AS provider_id, s_name AS provider_name,
            {sql_pick(V.PROVIDER_TYPES, 's_suppkey % 10')} AS provider_type,
            {_REGION.format(key='s_nationkey')} AS region,
            s_suppkey % 35 + 1 AS license_years, s_acctbal >= 0 AS is_active
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "customer_providers": f"""
        SELECT c_custkey AS provider_id, c_name AS provider_name,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'repair_shop' WHEN 'BUILDING' THEN 'hospital'
                WHEN 'FURNITURE' THEN 'clinic' WHEN 'HOUSEHOLD' THEN 'legal' ELSE 'lab' END AS provider_type,
            {_REGION.format(key='c_nationkey')} AS region,
            cast(floor(c_acctbal / 200) as double) AS balance_pct
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "incidents": f"""
        SELECT o_orderkey AS incident_number, printf('INC-%06d', o_orderkey) AS incident_id,
            cast(o_orderdate as date) AS incident_date,
            {sql_pick(V.INCIDENT_TYPES, 'o_custkey % 8')} AS incident_type,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
                WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
            {sql_pick(V.INCIDENT_STATUSES, 'dayofmonth(o_orderdate) % 5')} AS status,
            {sql_pick(V.SOURCE_COUNTRIES, 'o_custkey % 10')} AS source_country,
            {sql_pick(V.TARGET_SYSTEMS, 'dayofyear(o_orderdate) % 7')} AS target_system,
            {sql_pick(V.DETECTION_METHODS, 'o_orderkey % 5')} AS detection_method,
            floor(o_totalprice * 0.0144::double) / 100 AS response_time_hours,
            floor(o_totalprice * 0.04::double) / 100 AS resolution_time_hours,
            cast(floor(o_totalprice * 0.0002::double) as bigint) AS impact_score,
            o_custkey % 500 + 1 AS affected_records, o_totalprice AS financial_impact_usd,
            (o_orderstatus = 'P' AND o_totalprice > 300000) AS data_breach,
            ((o_orderstatus = 'P' AND o_totalprice > 300000) OR o_orderpriority = '1-URGENT')
                AS regulatory_report_required
        FROM orders""",
    "alerts": f"""
        SELECT concat_ws('-', 'ALT', l_orderkey, l_linenumber, l_partkey) AS alert_id,
            l_shipdate AS alert_timestamp,
            {sql_pick(V.ALERT_SOURCES, 'l_linenumber % 6')} AS source_system,
            {sql_pick(V.ALERT_TYPES, 'l_partkey % 8')} AS alert_type,
            CASE WHEN l_quantity > 48 THEN 'critical' WHEN l_quantity > 42 THEN 'high'
                WHEN l_quantity > 27 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'info' END AS severity,
            {sql_pick(V.ALERT_STATUSES, 'cast(round(l_discount * 100) as integer) % 5')} AS status,
            cast(round(l_discount * 100) as integer) % 5 = 4 AS is_false_positive,
            CASE WHEN l_returnflag = 'A' THEN l_orderkey END AS linked_incident_number,
            CASE WHEN l_returnflag = 'A' THEN printf('INC-%06d', l_orderkey) END AS linked_incident_id,
            round(l_tax * 100) / 10 + 0.125::double AS confidence_score
        FROM lineitem""",
    "requests": f"""
        SELECT event_id AS request_id, ts AS requested_at,
            {sql_pick(V.CLAIM_TYPES, 'user_id % 5')} AS claim_type,
            value * 5000 - 500 AS claim_amount_hkd,
            {sql_pick(V.DISTRICTS, 'user_id % 22')} AS region,
            CASE WHEN event_type <> 'error' THEN {sql_pick(V.PROVIDER_TYPES, 'user_id % 10')} END AS provider_type,
            {sql_pick(V.CHANNELS, 'event_id % 5')} AS submission_channel,
            cast(json_extract_string(props, '$.k') as bigint) AS processing_days,
            value AS provider_flagged_pct, event_type
        FROM events""",
    "sections": """
        SELECT source AS doc_id, 'Policy ' || source AS doc_title, 'Section ' || doc_id AS section_title,
            lang AS doc_type, text AS section_content, doc_id AS section_number
        FROM documents""",
    "questions": "SELECT item_id AS question_id, text AS question FROM benchmark",
}


def with_roles(roles: str, query: str) -> str:
    """``WITH role AS (...), ... query``. A query that starts with WITH is merged in."""
    parts = [f"{name} AS ({ROLES[name]})" for name in roles.split()]
    query = query.strip()
    if query.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + query[5:]
    return "WITH " + ", ".join(parts) + " " + query
