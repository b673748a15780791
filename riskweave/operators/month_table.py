"""Monthly metrics kept as mergeable sums, so that reports read no facts.

Per month the table holds counts, sums in whole decimals and, for the median, how many incidents
have each response time. A batch of facts is summed by month on its own and added to what is
there; only the touched months' response times are written anew. Batches are versions
(``sources/versions.py``): one that is repeated changes nothing, and readers see a batch whole.
Facts are only added; each fact must come in one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.functions.scalars import month_of, rounded
from riskweave.operators.metrics import combine_months
from riskweave.operators.ranks import exact_median
from riskweave.sources import versions

_SUMS = "sums"


def _decimals(x: Column) -> Column:
    return F.sum(x.cast("decimal(28,6)"))


def incident_sums(incidents: DataFrame) -> DataFrame:
    """One row per month, every column a sum."""
    severity = F.col("severity")
    return incidents.groupBy(month_of(F.col("incident_date")).alias("month")).agg(
        F.count("incident_id").alias("total"), F.count_if(severity == "critical").alias("critical"),
        F.count_if(severity == "high").alias("high"),
        _decimals(F.col("response_time_hours")).alias("response"), F.count("response_time_hours").alias("responses"),
        _decimals(F.col("resolution_time_hours")).alias("resolution"), F.count("resolution_time_hours").alias("resolutions"),
        _decimals(F.col("financial_impact_usd")).alias("financial"), F.count_if("data_breach").alias("breaches"),
        F.count_if("regulatory_report_required").alias("reports"),
        F.sum("impact_score").cast("decimal(38,6)").alias("impact"), F.count("impact_score").alias("impacts"),
        F.sum("affected_records").cast("long").alias("records"))


def alert_sums(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(month_of(F.col("alert_timestamp")).alias("month")).agg(
        F.count("alert_id").alias("total"), F.count_if("is_false_positive").alias("false_positives"),
        F.count("linked_incident_id").alias("linked"),
        _decimals(F.col("confidence_score")).alias("confidence"), F.count("confidence_score").alias("confidences"))


def response_counts(incidents: DataFrame) -> DataFrame:
    """month, value and n: how many incidents of the month have the response time."""
    known = incidents.filter("response_time_hours IS NOT NULL AND incident_date IS NOT NULL")
    return known.groupBy(month_of(F.col("incident_date")).alias("month"), F.col("response_time_hours").alias("value"))\
        .agg(F.count("*").alias("n"))


def _added(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    if old is None:
        return new
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).cast(new.schema[c].dataType).alias(c) for c in new.columns if c not in keys])


def _fold(new: DataFrame, values: DataFrame | None, path: str, number: int) -> bool:
    spark = new.sparkSession
    before, parts = versions.latest(spark, path)
    if number <= before:
        return False
    folder = versions.new_folder()
    old = spark.read.schema(new.schema).parquet(f"{path}/{parts[_SUMS]}") if parts else None
    _added(old, new, ["month"]).coalesce(1).write.parquet(f"{path}/{folder}/sums")
    now = {**parts, _SUMS: f"{folder}/sums"}
    if values is not None:
        values = values.withColumn("part", F.date_format("month", "yyyy-MM")).persist()
        touched = sorted(r[0] for r in values.select("part").distinct().collect())  # months
        read = [f"{path}/{parts[m]}" for m in touched if m in parts]
        kept = spark.read.schema(values.drop("part").schema).parquet(*read).withColumn("part", F.date_format("month", "yyyy-MM")) if read else None
        rows = _added(kept, values, ["month", "value", "part"])
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{folder}/values")
        values.unpersist()
        now.update({m: f"{folder}/values/part={m}" for m in touched})
    return versions.commit(spark, path, number, now)


def fold_incidents(incidents: DataFrame, path: str, number: int) -> bool:
    """Add a batch of incidents as version ``number``; False if that is there already."""
    return _fold(incident_sums(incidents), response_counts(incidents), f"{path}/incidents", number)


def fold_alerts(alerts: DataFrame, path: str, number: int) -> bool:
    return _fold(alert_sums(alerts), None, f"{path}/alerts", number)


def sync_months(facts: DataFrame, fold, path: str, checkpoint: str) -> StreamingQuery:
    """Fold every micro-batch of a stream of facts in, with ``fold_incidents`` or ``fold_alerts``."""
    return facts.writeStream.foreachBatch(lambda batch, number: fold(batch, path, number))\
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mean(total: str, n: str, digits: int) -> Column:
    return rounded(F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0)), digits)


def incident_months(spark: SparkSession, path: str, median: bool = True) -> DataFrame:
    """The incident side; without the median no response times are read."""
    _, parts = versions.latest(spark, f"{path}/incidents")
    sums = spark.read.parquet(f"{path}/incidents/{parts[_SUMS]}")
    months = [f"{path}/incidents/{folder}" for name, folder in parts.items() if name != _SUMS]
    out = sums.select(
        "month", F.col("total").alias("total_incidents"), F.col("critical").alias("critical_incidents"),
        F.col("high").alias("high_incidents"), _mean("response", "responses", 2).alias("avg_response_time_hours"),
        _mean("resolution", "resolutions", 2).alias("avg_resolution_time_hours"),
        F.col("financial").cast("double").alias("total_financial_impact_usd"), F.col("breaches").alias("data_breach_count"),
        F.col("reports").alias("regulatory_reports_filed"), _mean("impact", "impacts", 2).alias("avg_impact_score"),
        F.col("records").alias("total_affected_records"))
    if not months or not median:
        return out.withColumn("median_response_time_hours", F.lit(None).cast("double"))
    middle = exact_median(spark.read.parquet(*months), ["month"], "value", "_median", weight="n")
    return out.join(middle, "month", "left").withColumn("median_response_time_hours", rounded(F.col("_median"), 2)).drop("_median")


def alert_months(spark: SparkSession, path: str) -> DataFrame:
    _, parts = versions.latest(spark, f"{path}/alerts")
    return spark.read.parquet(f"{path}/alerts/{parts[_SUMS]}").select(
        "month", F.col("total").alias("total_alerts"), F.col("false_positives").alias("false_positive_count"),
        F.col("linked").alias("alerts_linked_to_incidents"), _mean("confidence", "confidences", 3).alias("avg_confidence_score"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """The monthly metrics as the kept table gives them."""
    return combine_months(incident_months(spark, path), alert_months(spark, path))


def trend(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of the incident and alert sides by month; response times are read for the median only."""
    median = "median_response_time_hours" in columns
    return combine_months(incident_months(spark, path, median), alert_months(spark, path)).select("month", *columns).orderBy("month")
