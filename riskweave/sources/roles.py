"""Bind the given tables to the domain roles: claims, scores, providers, incidents,
alerts, requests, sections and questions.

Every binding is a plain projection of one table, so filters on role columns reach the
Parquet scan and only the columns a query uses are read. Only regions join the 25-row
nation table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions import risk
from riskweave.functions.scalars import constant_list, padded_id, pick
from riskweave.sources.tables import read_table


def _percent(x: str) -> Column:
    """0.07 -> 7"""
    return F.rint(F.col(x) * 100).cast("int")


def line_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as claims: many rows, no unique key. Providers are suppliers."""
    t = read_table(spark, folder, "lineitem")
    flagged = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)
    indicators = F.concat_ws(
        ", ",
        F.when(F.col("l_discount") >= 0.08, F.lit("inflated_amount")),
        F.when(F.col("l_quantity") <= 40, F.lit("rapid_succession")),
        F.when(F.col("l_tax") >= 0.06, F.lit("out_of_network")),
        F.when(F.col("l_linenumber") >= 6, F.lit("multiple_policies")),
    )
    status = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "pending")
        .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "under_review")
        .when(F.col("l_linestatus") == "O", "denied")
        .when(F.col("l_returnflag") == "N", "approved")
        .otherwise("paid")
    )
    return t.select(
        F.col("l_orderkey").alias("policyholder_id"),
        F.col("l_suppkey").alias("provider_id"),
        pick(list(V.CLAIM_TYPES), F.col("l_linenumber") % 5).alias("claim_type"),
        F.col("l_shipdate").cast("date").alias("claim_date"),
        (F.rint(F.col("l_extendedprice") * 780) / 100).alias("claim_amount_hkd"),
        status.alias("status"),
        pick(list(V.CHANNELS), _percent("l_discount") % 5).alias("submission_channel"),
        F.col("l_quantity").cast("long").alias("processing_days"),
        flagged.alias("is_flagged"),
        F.when(flagged, F.nullif(indicators, F.lit(""))).alias("fraud_indicators"),
        F.rint(F.col("l_tax") * 1000).alias("provider_flagged_pct"),
        F.col("l_linenumber").cast("long").alias("line_number"),
        F.col("l_partkey").alias("part_id"),
    )


def order_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as claims: ``claim_id`` is unique. Providers are customers."""
    t = read_table(spark, folder, "orders")
    return t.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("provider_id"),
        pick(list(V.CLAIM_TYPES), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("claim_type"),
        F.col("o_orderdate").cast("date").alias("claim_date"),
        F.col("o_totalprice").alias("claim_amount_hkd"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "paid")
        .otherwise("under_review").alias("status"),
        pick(list(V.CHANNELS), F.dayofmonth("o_orderdate") % 5).alias("submission_channel"),
        (F.dayofyear("o_orderdate") % 90 + 1).cast("long").alias("processing_days"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 350_000)).alias("is_flagged"),
    )


def order_scores(spark: SparkSession, folder: str) -> DataFrame:
    """One score per order, with many ties."""
    score = ((F.col("o_orderkey") * 7919) % 1001).cast("double") / 10
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"), score.alias("fraud_score"),
        risk.risk_category(score).alias("risk_category"))


def _region(nation_key: str) -> Column:
    """A district for the first nations; the rest keep their own name."""
    return F.coalesce(F.try_element_at(constant_list(V.DISTRICTS), F.col(nation_key) + 1), F.col("n_name"))


def supplier_providers(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    t = read_table(spark, folder, "supplier")
    return t.join(nation, t.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("provider_id"),
        F.col("s_name").alias("provider_name"),
        pick(list(V.PROVIDER_TYPES), F.col("s_suppkey") % 10).alias("provider_type"),
        _region("s_nationkey").alias("region"),
        (F.col("s_suppkey") % 35 + 1).alias("license_years"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


def customer_providers(spark: SparkSession, folder: str) -> DataFrame:
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    t = read_table(spark, folder, "customer")
    return t.join(nation, t.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("provider_id"),
        F.col("c_name").alias("provider_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "repair_shop")
        .when(F.col("c_mktsegment") == "BUILDING", "hospital")
        .when(F.col("c_mktsegment") == "FURNITURE", "clinic")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "legal")
        .otherwise("lab").alias("provider_type"),
        _region("c_nationkey").alias("region"),
        F.floor(F.col("c_acctbal") / 200).cast("double").alias("balance_pct"),
    )


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as incidents; ``incident_id`` is unique."""
    t = read_table(spark, folder, "orders")
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    )
    breach = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300_000)
    day = F.dayofyear("o_orderdate")
    return t.select(
        F.col("o_orderkey").alias("incident_number"),
        padded_id("INC", 6, F.col("o_orderkey")).alias("incident_id"),
        F.col("o_orderdate").cast("date").alias("incident_date"),
        pick(list(V.INCIDENT_TYPES), F.col("o_custkey") % 8).alias("incident_type"),
        severity.alias("severity"),
        pick(list(V.INCIDENT_STATUSES), F.dayofmonth("o_orderdate") % 5).alias("status"),
        pick(list(V.SOURCE_COUNTRIES), F.col("o_custkey") % 10).alias("source_country"),
        pick(V.TARGET_SYSTEMS, day % 7).alias("target_system"),
        pick(list(V.DETECTION_METHODS), F.col("o_orderkey") % 5).alias("detection_method"),
        (F.floor(F.col("o_totalprice") * 0.0144) / 100).alias("response_time_hours"),
        (F.floor(F.col("o_totalprice") * 0.04) / 100).alias("resolution_time_hours"),
        F.floor(F.col("o_totalprice") * 0.0002).cast("long").alias("impact_score"),
        (F.col("o_custkey") % 500 + 1).alias("affected_records"),
        F.col("o_totalprice").alias("financial_impact_usd"),
        breach.alias("data_breach"),
        (breach | (F.col("o_orderpriority") == "1-URGENT")).alias("regulatory_report_required"),
    )


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as alerts; about a third link to the incident of their order."""
    t = read_table(spark, folder, "lineitem")
    status = pick(list(V.ALERT_STATUSES), _percent("l_discount") % 5)
    link = F.when(F.col("l_returnflag") == "A", F.col("l_orderkey"))
    q = F.col("l_quantity")
    severity = F.when(q > 48, "critical").when(q > 42, "high").when(q > 27, "medium")\
        .when(q > 10, "low").otherwise("info")
    return t.select(
        F.concat_ws("-", F.lit("ALT"), "l_orderkey", "l_linenumber", "l_partkey").alias("alert_id"),
        F.col("l_shipdate").alias("alert_timestamp"),
        pick(list(V.ALERT_SOURCES), F.col("l_linenumber") % 6).alias("source_system"),
        pick(list(V.ALERT_TYPES), F.col("l_partkey") % 8).alias("alert_type"),
        severity.alias("severity"),
        status.alias("status"),
        (status == "false_positive").alias("is_false_positive"),
        link.alias("linked_incident_number"),
        F.when(link.isNotNull(), padded_id("INC", 6, F.col("l_orderkey"))).alias("linked_incident_id"),
        (F.rint(F.col("l_tax") * 100) / 10 + 0.125).alias("confidence_score"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_from(read_table(spark, folder, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as scoring requests. Some must be refused."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("requested_at"),
        pick(list(V.CLAIM_TYPES), F.col("user_id") % 5).alias("claim_type"),
        (F.col("value") * 5000 - 500).alias("claim_amount_hkd"),
        pick(V.DISTRICTS, F.col("user_id") % 22).alias("region"),
        F.when(F.col("event_type") != "error", pick(list(V.PROVIDER_TYPES), F.col("user_id") % 10))
        .alias("provider_type"),
        pick(list(V.CHANNELS), F.col("event_id") % 5).alias("submission_channel"),
        k.alias("processing_days"),
        F.col("value").alias("provider_flagged_pct"),
        F.col("event_type"),
    )


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sections: each source is one policy document with many sections."""
    return read_table(spark, folder, "documents").select(
        F.col("source").alias("doc_id"),
        F.concat(F.lit("Policy "), "source").alias("doc_title"),
        F.concat(F.lit("Section "), F.col("doc_id").cast("string")).alias("section_title"),
        F.col("lang").alias("doc_type"),
        F.col("text").alias("section_content"),
        F.col("doc_id").alias("section_number"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
