"""Reading, writing, dropping and capturing tables."""

from pyspark.sql import functions as F

from riskweave.operators import reports
from riskweave.operators.joins import with_score
from riskweave.session import scratch_dir
from riskweave.sources import roles, tables
from riskweave.streaming.scoring import capture


def test_overwrite_replaces_schema_and_drop_goes_on(spark):
    tables.ensure_schema(spark, "risk_demo")
    tables.ensure_schema(spark, "risk_demo")
    first = tables.local_rows(spark, [(1, "a"), (2, "b")], "id long, name string")
    tables.overwrite_table(first, "risk_demo.items")
    tables.overwrite_table(first.select("id", F.lit(1.5).alias("score")), "risk_demo.items")
    assert spark.table("risk_demo.items").columns == ["id", "score"]
    outcome = dict(tables.drop_tables(spark, ["risk_demo.items", "risk_demo.never", "no.such.catalog.t"]))
    assert outcome["risk_demo.items"] == outcome["risk_demo.never"] == "dropped"
    assert outcome["no.such.catalog.t"].startswith("skipped")
    assert not spark.catalog.tableExists("risk_demo.items")


def test_bucketed_tables_join_without_shuffle(spark, folder):
    tables.ensure_schema(spark, "risk_demo")
    tables.overwrite_table(roles.order_claims(spark, folder), "risk_demo.claims", "claim_id", 4)
    tables.overwrite_table(roles.order_scores(spark, folder), "risk_demo.scores", "claim_id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_score(spark.table("risk_demo.claims"), spark.table("risk_demo.scores"), "fraud_score")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == roles.order_claims(spark, folder).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        tables.drop_tables(spark, ["risk_demo.claims", "risk_demo.scores"])


def test_audit_notices_lost_rows(spark):
    whole = spark.range(10)
    rows = tables.write_audit({"good": (whole, spark.range(10)), "short": (whole, spark.range(9))}).collect()
    assert [tuple(r) for r in rows] == [("good", 10, 10, True), ("short", 10, 9, False)]


def test_append_by_date_keeps_all_rows(spark, tmp_path):
    df = spark.range(1000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("day"))
    path = str(tmp_path / "by_date")
    tables.append_by_date(df, path, "day")
    tables.append_by_date(df, path, "day")
    assert spark.read.parquet(path).count() == 2000
    assert len(list((tmp_path / "by_date").glob("day=*"))) == 3


def test_capture_does_not_repeat_rows(spark, folder, tmp_path):
    path, checkpoint = str(tmp_path / "scores"), str(tmp_path / "checkpoint")
    for _ in range(2):
        stream = tables.stream_table(spark, folder, "events")
        capture(roles.requests_from(stream), path, checkpoint).awaitTermination()
    scored = spark.read.parquet(path)
    assert scored.count() == scored.select("request_id").distinct().count() > 0
    assert {"scored_at", "scored_date", "claim_type"} <= set(scored.columns)


def test_scratch_dir_is_fresh(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_pack_runs_on_other_tables(spark):
    claims = tables.local_rows(
        spark, [(1, True, 10.0), (2, False, 20.0)], "provider_id long, is_flagged boolean, claim_amount_hkd double")
    row = reports.claims_kpi(claims).first()
    assert tuple(row) == (2, 1, 0.5, 15.0)


def test_kpi_of_no_claims(spark):
    claims = tables.local_rows(spark, [], "is_flagged boolean, claim_amount_hkd double")
    assert tuple(reports.claims_kpi(claims).first()) == (0, 0, None, None)


def test_stream_reads_files_and_folders_of_parts(spark, folder, tmp_path):
    rows = tables.read_table(spark, folder, "events")
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for place in (folder, str(tmp_path)):
        out = f"{tmp_path}/out-{place == folder}"
        stream = tables.stream_table(spark, place, "events").writeStream.trigger(availableNow=True)
        stream.option("checkpointLocation", f"{out}-checkpoint").format("parquet").start(out).awaitTermination()
        assert spark.read.parquet(out).count() == rows.count()
