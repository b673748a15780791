"""The registered queries against their SQL, and the pipeline stage by stage."""

import collections

import pytest

import corpus_pipeline
import oracle
from riskweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, name):
    assert oracle.spark_rows(QUERIES[name](spark, folder)) == oracle.sql_rows(oracle.connect(folder), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_whole_table(spark, folder, name):
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    all_ids = {r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in QUERIES[name](spark, folder).select(key).collect()} == all_ids


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "personal_data", "mix", "pack"]
    kept = collections.OrderedDict()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "pack":
            assert docs.columns == columns
        docs = docs.cache()
        kept[name] = docs
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert ids["near_dedup"] == ids["personal_data"] and ids["near_dedup"] < ids["language"]
    assert kept["personal_data"].filter("text LIKE '%@mail%.example.com%'").count() == 0
    assert ids["pack"] == ids["mix"] <= ids["personal_data"]
    empty = spark.createDataFrame([], spark.read.parquet(f"{folder}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
