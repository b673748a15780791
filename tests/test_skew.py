"""Results when one key holds most rows and joins cannot broadcast."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import joins, reports

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def claims(spark):
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 200)
    return spark.range(60_000).repartition(16).select(
        F.col("id").alias("claim_id"), hot.alias("provider_id"), (F.col("id") % 7 == 0).alias("is_flagged"),
        F.lit("travel").alias("claim_type"), F.md5(F.col("id").cast("string")).alias("payload"))


@pytest.fixture(scope="module")
def providers(spark):
    return spark.range(200).select(F.col("id").alias("provider_id"),
                                   F.concat(F.lit("R"), (F.col("id") % 5).cast("string")).alias("region"))


def test_row_join_splits_the_hot_key(spark, claims, providers, no_broadcast):
    joined = joins.with_provider(claims, providers, "region")
    rows = joined.select("claim_id", "provider_id", "region", "payload").collect()
    assert len(rows) == len({r.claim_id for r in rows}) == 60_000
    assert all(r.region == f"R{r.provider_id % 5}" for r in rows)
    plan_df = joined.select("claim_id", "region", "payload")
    plan_df.collect()
    assert "skew=true" in plan_df._jdf.queryExecution().executedPlan().toString()


def test_counts_by_area_move_one_row_per_provider(spark, claims, providers, no_broadcast):
    got = {r.area: (r.total_claims, r.flagged_claims) for r in reports.fraud_by_area(claims, providers).collect()}
    wanted = {}
    for i in range(60_000):
        provider = 1 if i % 3 == 0 else i % 200
        area = f"R{provider % 5}"
        total, flagged = wanted.get(area, (0, 0))
        wanted[area] = (total + 1, flagged + (i % 7 == 0))
    assert got == wanted


def test_null_keys_spread_over_tasks(spark, no_broadcast):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("link"))
    right = spark.range(50).select(F.col("id").alias("key"), F.col("id").alias("name"))
    joined = joins.left_join_sparse_key(left, right, "link", "key", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        unmatched = joined.filter("name is null").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and unmatched == 18_000
    assert max(sizes) < 20_000 / 4


def test_hot_keys_are_found_and_spread_without_settings(spark, claims, providers):
    """A third of all rows has one key: no task takes more than a few times the median."""
    left = claims.select("claim_id", F.when(F.col("claim_id") % 11 > 0, F.col("provider_id")).alias("provider_id"))
    assert 1 in joins.hot_keys(left, "provider_id")
    right = providers.unionAll(providers.filter("provider_id = 1")).hint("merge")
    for how in ("inner", "left"):
        joined = joins.join_hot_keys(left, right, "provider_id", how)
        plain = left.join(right, "provider_id", how)
        assert joined.columns == plain.columns
        key = lambda df: sorted(map(str, df.groupBy("provider_id", "region").count().collect()))
        assert key(joined) == key(plain)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joins.join_hot_keys(left, right, "provider_id", "left")
                 .groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 8 and max(sizes) <= 3 * sorted(sizes)[4]
