"""Joins of large fact tables to keyed tables.

No broadcast hints: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, where adaptive
execution splits a hot key over several tasks. What adaptive execution cannot spread
well, null keys of an outer join, is spread by a second join column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_provider(claims: DataFrame, providers: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Claims with the named provider columns. Only those columns are read."""
    return claims.join(providers.select("provider_id", *columns), "provider_id", how)


def with_score(claims: DataFrame, scores: DataFrame, *columns: str) -> DataFrame:
    """Claims with the named columns of their one score row."""
    return claims.join(scores.select("claim_id", *columns), "claim_id")


#: Keys with at least one in this many rows may be hot; tasks over which a hot key is spread.
HOT_SHARE, SALTS = 1000, 32


def hot_keys(df: DataFrame, key: str) -> list:
    """All keys that hold one in ``HOT_SHARE`` rows or more, and perhaps some others: a sketch of
    bounded size, made in one pass over the key column. At most some thousand keys."""
    return [k for k in df.filter(F.col(key).isNotNull()).stat.freqItems([key], 1 / HOT_SHARE).first()[0] if k is not None]


def join_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on a key that few values of the left side may fill, inner or left.

    Only hot keys are salted: their left rows are spread over ``salts`` tasks by a hash of the row
    and their right rows copied for each. All others, and null keys of a left join, meet as they
    are, the nulls spread like a hot key. It needs no session setting and keeps all rows of a
    repeated right key. Use it where the right side is too large to broadcast.
    """
    hot = hot_keys(left, key)
    kind = right.schema[key].dataType
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salted = left.withColumn(key, F.col(key).cast(kind)).withColumn(
        "_salt", F.when(F.col(key).isNull() | is_hot, spread).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")


def left_join_sparse_key(left: DataFrame, right: DataFrame, key: str, right_key: str, spread_by: str) -> DataFrame:
    """Left join on a key that is mostly null.

    All null keys would hash to one task. A second join column, the hash of the key on both
    sides but of ``spread_by`` where the key is null, sends those rows to all tasks.
    """
    # Equal keys of different types hash differently, so both sides hash the right side's type.
    same_type = F.col(key).cast(right.schema[right_key].dataType)
    spread = F.when(F.col(key).isNull(), F.xxhash64(spread_by)).otherwise(F.xxhash64(same_type))
    wide = left.withColumn("_spread", spread)
    keyed = right.withColumn("_right_spread", F.xxhash64(right_key))
    return wide.join(
        keyed,
        (F.col(key) == F.col(right_key)) & (F.col("_spread") == F.col("_right_spread")),
        "left",
    ).drop("_spread", "_right_spread", right_key)


def linked(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts whose incident exists."""
    keys = incidents.select(F.col("incident_id").alias("linked_incident_id"))
    return alerts.filter(F.col("linked_incident_id").isNotNull())\
        .join(keys, "linked_incident_id", "left_semi")


def removed_keys(indexed: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Keys still indexed but no longer in the source."""
    return indexed.select(key).join(source.select(key), key, "left_anti")
