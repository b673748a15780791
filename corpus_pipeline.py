"""From raw documents to packed sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import language, mixing, neardup, packing, pii
from riskweave.llm.common import bounded_batches
from riskweave.session import written

TOKENIZER = "byte_bpe_50k.json"


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages; text without letters, or with under half of them in such languages, goes."""
    bounded_batches(spark)
    labelled = docs.filter(~language.held_out(F.col("doc_id")))
    return language.keep_known(docs, language.fit(labelled))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words to a shingle, 0.8 or more alike."""
    bounded_batches(spark)
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    bounded_batches(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents repeated where that takes more than one epoch."""
    taken = mixing.mixed(docs)
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix, packed into sequences of 1,024 tokens."""
    bounded_batches(spark, 2)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", languages), ("near_dedup", near_dedup), ("personal_data", personal_data),
          ("mix", mix), ("pack", pack)]

#: No stage but the mix can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
