"""Exact ranks, medians and areas under curves without a one-task sort.

A window over a whole table, or over a group that holds a third of it, sorts that
group in one task. Here rows are first cut into value buckets of about equal size,
the same cut points for every group, so no (group, bucket) holds more than about one
bucket's share of the table. Bucket totals are few and give every bucket its starting
rank; the sort then runs per (group, bucket). The cut points are approximate, which
affects balance only, never results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

BUCKET_BITS = 10
#: Rows of a bucket that one task sorts; a fuller one is cut into buckets once more.
ROWS_AT_ONCE = 1 << 20


def _cut_points(value: Column, bits: int) -> Column:
    n = 1 << bits
    # One literal instead of a thousand; Spark folds it into a constant array.
    shares = F.split(F.lit(",".join(repr(i / n) for i in range(1, n))), ",").cast("array<double>")
    return F.percentile_approx(value, shares, 4 * n)


def _bucket(value: Column, cuts: Column, bits: int) -> Column:
    """How many cut points are not above the value, by binary search. Never null, so joins
    on it add no filter that would run this below an aggregation."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(cuts, at + step) <= value, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def _bucketed(df: DataFrame, value: str, bits: int) -> DataFrame:
    cuts = df.agg(_cut_points(F.col(value), bits)).scalar()
    return df.withColumn("_cuts", cuts)\
        .withColumn("_bucket", _bucket(F.col(value), F.col("_cuts"), bits)).drop("_cuts")


def _bucket_starts(tagged: DataFrame, groups: Sequence[str], weight: str) -> DataFrame:
    """Weight before each bucket and in total. At most 2^bits rows per group."""
    per_bucket = tagged.groupBy(*groups, "_bucket").agg(F.sum(weight).alias("_in_bucket"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.withColumns({
        "_start": F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)),
        "_total": F.sum("_in_bucket").over(whole),
    })


def with_preceding(
    df: DataFrame, groups: Sequence[str], value: str, weight: str, bits: int = BUCKET_BITS,
) -> DataFrame:
    """Add ``preceding``: the weight of the group's rows with a smaller value.

    ``value`` must be unique within its group; pre-aggregate equal values.
    """
    tagged = _bucketed(df, value, bits)
    starts = _bucket_starts(tagged, groups, weight).select(*groups, "_bucket", "_start")
    within = Window.partitionBy(*groups, "_bucket").orderBy(value)\
        .rowsBetween(Window.unboundedPreceding, -1)
    return (
        tagged.join(starts, [*groups, "_bucket"])
        .withColumn("preceding", F.col("_start") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_bucket", "_start")
    )


def numbered(df: DataFrame, groups: Sequence[str], order: str, name: str) -> DataFrame:
    """Number rows 1, 2, 3 within each group by a unique order column. The same rows
    always get the same numbers, however they are partitioned. Rows without a group or
    an order value have no number and are left out."""
    one = _present(df, [*groups, order]).withColumn("_one", F.lit(1).cast("long"))
    return with_preceding(one, groups, order, "_one")\
        .withColumn(name, F.col("preceding") + 1).drop("_one", "preceding")


def sorted_positions(df: DataFrame, group: str, value: str, amounts: dict[str, Column]) -> DataFrame:
    """Add columns, each the sum of an amount over the group's rows with a smaller value.

    (group, value) is unique and of types that sort; rows are sorted over all tasks by it, so a
    group with most rows is spread like any other. Every task adds up its own rows; the tasks'
    totals, one row each, give it what comes before. Nulls sort first.
    """
    tagged = df.select(*df.columns, *[c.cast("long").alias(f"_a{i}") for i, c in enumerate(amounts.values())])
    # Cut, as sampled borders of tasks may differ when the rows are sorted once more. Without a
    # number, few rows come in few parts, which several passes below read.
    spread = cut_lineage(tagged.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()))
    added = [f"_a{i}" for i in range(len(amounts))]
    totals = spread.groupBy("_part", group).agg(*[F.sum(a).alias(a) for a in added])
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.col(group).alias("_group"), *[
        F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"{a}_start") for a in added])
    within = Window.partitionBy("_part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumns({f"{a}_before": F.coalesce(F.sum(a).over(within), F.lit(0)) for a in added})
    both = placed.alias("p").join(starts.alias("s"), (F.col("p._part") == F.col("s._part")) & F.col(f"p.{group}").eqNullSafe(F.col("s._group")))
    return both.select(*[F.col(f"p.{c}") for c in df.columns], *[
        (F.col(f"s.{a}_start") + F.col(f"p.{a}_before")).cast("long").alias(name) for a, name in zip(added, amounts, strict=True)])


def exact_median(
    df: DataFrame, groups: Sequence[str], value: str, name: str, bits: int = BUCKET_BITS, weight: str | None = None,
    most: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Interpolated median per group; null groups have none. With ``weight``, a row stands for so
    many. Equal values are merged first, and only the one or
    two buckets that hold the middle ranks are sorted; of more than ``most`` values, such a bucket
    is cut once more, and so on."""
    # The filter drops nulls and makes every use below read the same columns, so Spark
    # scans and groups once and reuses the exchange.
    counts = _present(df, groups).groupBy(*groups, value).agg(
        (F.sum(F.when(F.col(value).isNotNull(), F.col(weight))) if weight else F.count(value)).alias("_n")).filter("_n > 0")
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    end = F.col("_start") + F.col("_in_bucket")

    def holding(starts: DataFrame) -> DataFrame:
        return starts.filter((F.col("_start") <= high) & (low < end))

    tagged = _bucketed(counts, value, bits)
    middle = holding(_bucket_starts(tagged, groups, "_n"))
    held = cut_lineage(tagged.join(middle, [*groups, "_bucket"]))
    while held.groupBy(*groups, "_bucket").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > most:
        # Only the buckets that hold a middle rank are left; each is cut by the values in it.
        outer = [*groups, "_outer"]
        finer = _bucketed(held.withColumnRenamed("_bucket", "_outer"), value, bits)
        before = Window.partitionBy(*outer).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = finer.groupBy(*outer, "_bucket").agg(
            F.sum("_n").alias("_in_bucket"), F.first("_start").alias("_from"), F.first("_total").alias("_total"))\
            .withColumn("_start", F.col("_from") + F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).drop("_from")
        inner = finer.drop("_start", "_in_bucket", "_total").join(holding(starts), [*outer, "_bucket"])
        # Buckets of one group are told apart by where they start.
        held = cut_lineage(inner.withColumn("_bucket", F.col("_start")).drop("_outer"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(value)\
        .rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    last = F.col("_first") + F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < last), F.col(value)))

    return ranked.groupBy(*groups).agg(((at(low) + at(high)) / 2).alias(name))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: positives, negatives and the area under the ROC curve.

    The share of positive/negative pairs that are ordered rightly, ties counting half.
    Sums are exact whole numbers, so the result does not depend on row order.
    """
    # The filter drops the null score and makes every use below read the same columns, so
    # Spark scans and groups once and reuses the exchange.
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    ).filter(F.when(F.col(score).isNotNull(), F.col("positives") + F.col("negatives")) > 0)
    ranked = with_preceding(per_score, [], score, "negatives")
    wide = "decimal(38,0)"
    won_twice = F.col("positives").cast("decimal(19,0)") * (
        2 * F.col("preceding") + F.col("negatives")).cast("decimal(19,0)")
    sums = ranked.agg(
        F.sum("positives").alias("positives"),
        F.sum("negatives").alias("negatives"),
        F.sum(won_twice.cast(wide)).cast("double").alias("_won_twice"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        "positives", "negatives",
        (F.col("_won_twice") / F.nullif(2 * pairs, F.lit(0.0))).alias("auc"),
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test_percent: int, seed: int, bucket_digits: int = 3,
    most: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Add ``is_test``, true for exactly round(share * n) rows of each label.

    Labels are classes: one hash for each is looked up in a map. Rows are ordered by a keyed hash, so the split is random but repeatable. ``key`` must
    be unique. The first hash digits are the bucket: equal sizes by construction. A bucket of more
    than ``most`` rows is cut by the next digits.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    keyed = hashed.select(label, "_hash", F.lit(1).cast("long").alias("_one"))
    quota = F.expr(f"(_total * {test_percent} + 50) div 100")
    digits, rows, known = bucket_digits, keyed, None
    while True:
        # The one bucket per label in which the last test row lies; buckets are equal hash ranges.
        dealt = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
        starts = _bucket_starts(dealt, [label], "_one")
        if known is not None:
            starts = starts.drop("_total").join(known, label).withColumn("_start", F.col("_start") + F.col("_from"))
        cut = starts.withColumn("_quota", quota).filter(
            (F.col("_start") < F.col("_quota")) & (F.col("_quota") <= F.col("_start") + F.col("_in_bucket")))
        held = cut_lineage(dealt.join(cut.select(label, "_bucket", "_start", "_total", "_quota"), [label, "_bucket"]))
        if digits >= 32 or held.groupBy(label).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] <= most:
            break
        known = held.groupBy(label).agg(F.first("_start").alias("_from"), F.first("_total").alias("_total"))
        rows, digits = held.select(label, "_hash", "_one"), digits + bucket_digits
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash"))
    last = held.withColumn("_rank", F.col("_start") + rank).filter(F.col("_rank") == F.col("_quota"))
    # One hash per label, looked up without moving the rows.
    last_by_label = last.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_hash"))))).scalar()
    is_test = F.coalesce(F.col("_hash") <= F.try_element_at(last_by_label, F.col(label)), F.lit(False))
    return hashed.withColumn("is_test", is_test).drop("_hash")
