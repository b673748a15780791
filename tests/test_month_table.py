"""The kept month table, audited writes, the run registry and sized chunks."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from riskweave.operators import learning, metrics, month_table, retrieval
from riskweave.sources import roles, tables


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_batches_give_what_a_rebuild_gives(spark, folder, tmp_path):
    incidents, alerts = roles.incidents(spark, folder), roles.alerts(spark, folder)
    path = str(tmp_path / "m")
    first = F.col("incident_date") < "1997-03-10"
    assert month_table.fold_incidents(incidents.filter(first), path, 0)
    assert month_table.fold_alerts(alerts.filter("alert_id < 'ALT-1'"), path, 0)
    assert same(month_table.incident_months(spark, path), metrics.incident_months(incidents.filter(first)))
    assert month_table.fold_incidents(incidents.filter(~first | first.isNull()), path, 1)
    assert month_table.fold_alerts(alerts.filter("NOT coalesce(alert_id < 'ALT-1', false)"), path, 1)
    assert not month_table.fold_incidents(incidents, path, 1)  # a repeated batch
    assert same(month_table.metrics(spark, path), metrics.monthly_metrics(incidents, alerts))


def test_trends_scan_no_facts(spark, folder, tmp_path):
    path = str(tmp_path / "m")
    month_table.fold_incidents(roles.incidents(spark, folder), path, 0)
    month_table.fold_alerts(roles.alerts(spark, folder), path, 0)
    plan = month_table.trend(spark, path, "total_incidents", "false_positive_rate_pct")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan and "/values" not in plan


def test_months_of_a_stream(spark, folder, tmp_path):
    incidents = roles.incidents(spark, folder)
    source, path, checkpoint = (str(tmp_path / n) for n in ("facts", "m", "c"))
    for part in range(2):
        incidents.filter(F.pmod(F.xxhash64("incident_id"), F.lit(2)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(incidents.schema).parquet(source)
        month_table.sync_months(stream, month_table.fold_incidents, path, checkpoint).awaitTermination()
    assert same(month_table.incident_months(spark, path), metrics.incident_months(incidents))


def test_an_audited_write_runs_its_source_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        runs.add(1)
        return x

    df = spark.range(50).select(counted("id").alias("id"), F.lit("t").alias("t"))
    rows = tables.audited_write({"one": df, "none": df.limit(0)}, str(tmp_path)).collect()
    assert {(r.table, r.expected, r.actual, r.ok) for r in rows} == {("one", 50, 50, True), ("none", 0, 0, True)}
    assert runs.value == 50


def test_an_audit_sees_changed_rows(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "t") for i in range(5)], "id long, t string")
    real, seen = tables._marks, []

    def marks(of):
        seen.append(of)
        rows, checksum = real(of)
        if len(seen) == 2:  # what is read again
            checksum = F.sum(F.xxhash64("id", F.when(F.col("id") == 3, "u").otherwise(F.col("t"))).cast("decimal(38,0)")).alias("checksum")
        return rows, checksum

    monkeypatch.setattr(tables, "_marks", marks)
    row = tables.audited_write({"one": df}, str(tmp_path)).first()
    assert (row.expected, row.actual, row.ok) == (5, 5, False)


def test_runs_get_versions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [spark.createDataFrame([(f"run{i}", "auc", i / 10)], "run string, name string, value double") for i in range(5)]
    with ThreadPoolExecutor(5) as pool:
        made = list(pool.map(lambda df: learning.register_run(df, path), rows))
    assert sorted(made) == list(range(5))
    found = {r.run: r for r in learning.registered_runs(spark, path).collect()}
    assert {r: found[r].version for r in found} == {f"run{i}": v for i, v in enumerate(made)}
    assert {r.user for r in found.values()} == {spark.sql("SELECT current_user()").first()[0]}
    learning.set_alias(spark, path, "champion", 1)
    learning.set_alias(spark, path, "champion", 3)
    assert [tuple(r) for r in learning.aliased(spark, path).collect()] == [("champion", 3)]
    with pytest.raises(ValueError):
        learning.set_alias(spark, path, "champion", 9)


def test_sized_chunks(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(3, 12))) + rng.choice([".", "!", "?\n", ". "])
    parts = [sentence() for _ in range(400)]
    edited = parts[:200] + ["Something new here. "] + parts[201:]
    rows = [("d", 1, "".join(parts)), ("d", 2, "".join(edited)), ("d", 3, "x" * 5000), ("d", 4, None), ("d", 5, ""),
            ("d", 6, "No end"), ("d", 7, "." * 900 + " " * 3000 + "end"), ("d", 8, parts[0] * 300)]
    df = spark.createDataFrame(rows, "doc_id string, section_number int, section_content string").repartition(4)
    found = retrieval.sized_chunks(df, most=400).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.section_number, r.chunk_number)):
        by.setdefault(r.section_number, []).append(r)
    assert {n: "".join(r.chunk_text for r in by.get(n, [])) for _, n, _ in rows} == {n: t or "" for _, n, t in rows}
    assert max(len(r.chunk_text) for r in found) <= 400 and len({r.chunk_id for r in found}) == len(found)
    old, new = ([r.chunk_text for r in by[n]] for n in (1, 2))
    changed = set(old) ^ set(new)
    assert len(changed) <= 8 and len(old) > 20
