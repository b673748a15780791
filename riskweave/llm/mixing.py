"""Mixing sources to target weights.

Sources in code-point order, null last, get weights in turn. The whole word count is shared by
weight; a target stops at ``most`` times its source's size and the excess is reshared by weight
until none is above. A source is then taken in random order: whole epochs first, and for the rest
its documents sorted by a keyed hash, cut where the prefix sum of sizes meets the budget. The
document at the cut gives only the words that are still wanted.

The hash order is dealt into parts of equal shares of the hash range; part totals are few and give
each part its start, so no source, however large, is sorted in one task.

Null or wordless text has size 0 and takes 0 words. A null doc_id is a document like any other.
Rows repeated with the same id and size stand at one place in the order; if the cut falls there,
they share the words equally, rounded down. An empty table gives no rows. Extra columns are ignored
by ``mixture`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import word_count
from riskweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Documents of a part, about.
PART_ROWS = 5_000
#: One row per source is broadcast up to this size; else a source is spread over so many tasks.
BROADCAST_BYTES, SPREAD = 16 << 20, 64


def random_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target from (source, size): one row per source.

    Filling by weight under caps has one level: sources in order of cap / weight are full up to
    some point, and all others get the same amount per weight. The table is one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ratio = F.col("source_size") / F.col("w")
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    before = {"full": F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0)),
              "gone": F.coalesce(F.sum("w").over(upto), F.lit(0)),
              "total": F.sum("source_size").over(whole), "weights": F.sum("w").over(whole)}
    level = (F.col("total") - F.col("full")).cast("double") / (F.col("weights") - F.col("gone"))
    rows = per.withColumn("w", w).withColumn("ratio", ratio).withColumns(before)\
        .withColumn("level", level)\
        .withColumn("open", F.col("w") * F.col("level") <= F.col("source_size") * most)
    # The level of the first source that is not full holds for all after it.
    found = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(whole)
    return rows.select(
        "source", "source_size",
        F.when(F.col("ratio") < found["ratio"], (F.col("source_size") * most).cast("double"))
        .otherwise(F.least(F.col("w") * found["level"], (F.col("source_size") * most).cast("double"))).alias("target"))


def _words(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"))


def _with_source(rows: DataFrame, source: Column, per_source: DataFrame, name: str, spread: Column) -> DataFrame:
    """Rows with their source's row (one each, its source in ``name``). Those rows are broadcast if
    they stay within ``BROADCAST_BYTES``; beyond that a source is spread over ``SPREAD`` tasks by
    another column and its row copied for each."""
    per_source = cut_lineage(per_source)
    size = per_source.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 200), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_source), F.equal_null(source, F.col(name)))
    copies = per_source.withColumn("_part_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    own = F.pmod(F.xxhash64(spread), F.lit(SPREAD))
    return rows.withColumn("_own", own).join(copies, F.equal_null(source, F.col(name)) & (F.col("_own") == F.col("_part_of")))\
        .drop("_own", "_part_of")


def source_cuts(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 17,
) -> DataFrame:
    """One row per source: source, source_size, target, epochs (whole copies of every document) and
    the cut: documents whose (key, id, size) is below it are taken once more, those at it give
    ``last`` words."""
    # Repeated rows are one unit; parts are equal shares of the key's first 32 bits.
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))\
        .withColumn("key", random_key(F.col("doc_id"), seed))
    targets = source_targets(sized, weights, most)
    per = sized.groupBy("source").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))\
        .withColumnRenamed("source", "s1")
    plan = targets.join(per, F.equal_null("source", "s1")).withColumn("budget", F.round("target").cast("long"))\
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))\
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("s1", "budget")
    plan = cut_lineage(plan)
    dealt = _with_source(units, F.col("source"), plan.select(F.col("source").alias("s1"), "parts", "rest"), "s1", F.col("key"))\
        .withColumn("part", F.expr("(CAST(conv(substring(key, 1, 8), 16, 10) AS BIGINT) * parts) div 4294967296"))\
        .withColumn("words", F.col("size") * F.col("rows"))
    dealt = cut_lineage(dealt.filter("words > 0").select("source", "part", "key", "doc_id", "size", "rows", "words", "rest"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # The one part per source that holds the cut; only its documents are sorted.
    holding = dealt.groupBy("source", "part").agg(F.sum("words").alias("in_part"), F.first("rest").alias("rest"))\
        .withColumn("start", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))\
        .filter((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("in_part")))\
        .select(F.col("source").alias("s1"), F.col("part").alias("p1"), "start")
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cuts = dealt.join(holding, F.equal_null("source", "s1") & (F.col("part") == F.col("p1")))\
        .withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(within), F.lit(0)))\
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))\
        .select(F.col("source").alias("s2"), F.struct("key", "doc_id", "size").alias("cut"),
                F.expr("(rest - before) div rows").alias("last"))
    return plan.join(cuts, F.equal_null("source", "s2"), "left")\
        .select(F.col("source").alias("_source"), "source_size", "target", "epochs", "cut", "last")


def _taken(doc_id: Column, size: Column, seed: int) -> Column:
    """Words of a row that are taken once more."""
    own = F.struct(random_key(doc_id, seed).alias("key"), doc_id.alias("doc_id"), size.alias("size"))
    return F.when(F.col("cut").isNull(), F.lit(0).cast("long")).when(own < F.col("cut"), size)\
        .when(own == F.col("cut"), F.col("last")).otherwise(F.lit(0).cast("long"))


def mixture(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 17,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every row."""
    sized = cut_lineage(_words(documents))
    cuts = source_cuts(sized, weights, most, seed)
    extra = _taken(F.col("doc_id"), F.col("size"), seed)
    return _with_source(sized, F.col("source"), cuts, "_source", F.col("doc_id")).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mixed(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 17,
) -> DataFrame:
    """The mix itself, with the documents' columns: every row as often as it is taken. The document
    at a source's cut gives its first words, joined by single spaces. Texts are not moved; one row
    per source meets them."""
    cuts = source_cuts(cut_lineage(_words(documents)), weights, most, seed)
    columns = documents.columns
    given = {c: f"_given_{i}" for i, c in enumerate(columns)}  # no name of theirs can clash
    rows = documents.select(*[F.col(f"`{c}`").alias(given[c]) for c in columns])
    text, doc_id, source = (F.col(given[c]).cast(k) for c, k in (("text", "string"), ("doc_id", "long"), ("source", "string")))
    size = word_count(text)
    sized = _with_source(rows.withColumn("_size", size), source, cuts, "_source", doc_id)\
        .withColumn("_extra", _taken(doc_id, F.col("_size"), seed))
    copies = F.col("epochs").cast("int") + (F.col("_extra") > 0).cast("int")
    taken = sized.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = (F.col("_copy") > F.col("epochs")) & (F.col("_extra") < F.col("_size"))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
                                F.lit(1), F.col("_extra").cast("int")), " ")
    return taken.withColumn(given["text"], F.when(cut, head).otherwise(text))\
        .select(*[F.col(given[c]).alias(c) for c in columns])
