"""Scoring claims as they arrive. Stateless: each request gives one scored row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.scoring import accepted, score_by_rules


def scored_stream(requests: DataFrame) -> DataFrame:
    """Valid requests with their score; works on a stream and on a table alike."""
    return score_by_rules(accepted(requests))


def capture(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each scored request, with the request's columns and the scoring time, to a
    table partitioned by scoring date. Processes what is there and stops; the checkpoint
    and the file sink's log make a restart neither lose nor repeat rows."""
    stamped = scored_stream(requests).withColumn("scored_at", F.current_timestamp())\
        .withColumn("scored_date", F.to_date("scored_at"))
    return (
        stamped.writeStream.format("parquet").outputMode("append")
        .partitionBy("scored_date")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
