r"""Document fingerprints of closed syncmers.

A text's words ``[^\x20\x09-\x0D]+`` are hashed. Of every ``k`` words in a row, those are anchors
whose least word hash stands at the first or last place: whether a run of words is an anchor does
not depend on what surrounds it. Of two runs in a row at least one is an anchor, so every word is
in one. A fingerprint is all of a text's distinct anchors, each with its first position. Of two
texts, anchors that both have, at positions that differ by no more than a share of the longer
text, count twice, over all anchors of both.

All expressions are Spark's own. The next document is found by a window over ranges of doc_id
that hold about equally many documents; each range's upper bound is a document's id, and that
document is also given to the range above, so no range needs another.

Null text is empty; an empty text has an empty fingerprint, which is like another empty one (1) and
unlike any other (0). Fewer than ``k`` words are one anchor. A null doc_id counts as the least; ties
in doc_id go by text; a single document is its own next. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least bits of a position, words by which matched anchors may be apart, plus a share of the longer text.
PLACE_BITS, NEAR, DRIFT = 20, 16, 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def place_bits(n: Column) -> Column:
    """Bits of a position in a text of ``n`` words; the rest of an anchor's 64 are its hash."""
    return F.greatest(F.lit(PLACE_BITS), F.length(F.bin(n)))


def _packed(hashed: Column, place: Column, bits: Column) -> Column:
    high = F.call_function("shiftleft", F.call_function("shiftright", hashed, bits), bits)
    return high.bitwiseOR(place.cast("long"))


def _hash(packed: Column, bits: Column) -> Column:
    return F.call_function("shiftright", packed, bits)


def _place(packed: Column, bits: Column) -> Column:
    return packed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)


def _anchor(hashes: Column, at: Column, bits: Column) -> Column:
    """The packed anchor of the three words from a place on, or null."""
    one, two, three = (F.get(hashes, at + i) for i in range(3))
    inner_least = (two < one) & (two < three)
    return F.when(three.isNotNull() & ~inner_least, _packed(F.xxhash64(one, two, three), at, bits))


def anchors_of(hashes: Column, bits: Column) -> Column:
    """All anchors in order of their hashes, each hash once, from word hashes (k = 3, s = 1)."""
    short = F.array(_packed(F.xxhash64(hashes), F.lit(0), bits))
    anchors = F.when(F.size(hashes) >= 3, F.array_compact(F.transform(hashes, lambda _, i: _anchor(hashes, i, bits))))\
        .when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<bigint>"))
    ordered = F.sort_array(anchors)
    # A local name for the sorted array, so that it is sorted once.
    return F.element_at(F.transform(F.array(ordered), lambda a: F.filter(
        a, lambda x, i: (i == 0) | (_hash(x, bits) != _hash(F.get(a, i - 1), bits)))), 1)


def fingerprint(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Of two texts' anchors, given both texts' numbers of words."""
    bits = F.greatest(place_bits(n_a), place_bits(n_b))

    def widened(anchors: Column, own: Column) -> Column:
        return F.when(own == bits, anchors).otherwise(F.transform(
            anchors, lambda x: _packed(x, _place(x, own), bits)))

    both = F.sort_array(F.concat(widened(a, place_bits(n_a)), widened(b, place_bits(n_b))))
    allowed = F.greatest(n_a, n_b) / DRIFT + NEAR
    given = F.array(F.struct(both.alias("x"), allowed.alias("far"), bits.alias("bits")))
    met = F.element_at(F.transform(given, lambda s: F.size(F.filter(
        s["x"], lambda x, i: (i > 0) & (_hash(x, s["bits"]) == _hash(F.get(s["x"], i - 1), s["bits"]))
        & (F.abs(_place(x, s["bits"]) - _place(F.get(s["x"], i - 1), s["bits"])) <= s["far"])))), 1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2.0 * met / (F.size(a) + F.size(b)))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next``, a struct of the columns of the next row in descending doc_id; after the last
    comes the first."""
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(_LEAST))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts + 1)])
    # At most 4 ids per shuffle partition.
    found = rows.agg(F.percentile_approx(key, shares, 20 * parts).alias("cuts"), F.max(key).alias("most")).first()
    bounds = sorted({*(found["cuts"] or []), found["most"]} - {None}) or [_LEAST]
    bits = len(bounds).bit_length()
    padded = bounds + [_MOST] * ((1 << bits) - len(bounds))
    cuts = F.lit(",".join(map(str, padded)))
    table = F.split(cuts, ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    # How many bounds are below the key.
    range_of = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.element_at(table, at + step) < F.col("_key"), at + step).otherwise(at))
    at_bound = F.element_at(table, F.col("_range") + 1) == F.col("_key")
    above = F.pmod(F.col("_range") + 1, F.lit(len(bounds)))
    places = F.when(at_bound, F.array(
        F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost")),
        F.struct(above.alias("range"), F.lit(True).alias("ghost"))))\
        .otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("_key", key).withColumn("_range", range_of).withColumn("_place", F.explode(places))\
        .withColumns({"_range": F.col("_place.range"), "_ghost": F.col("_place.ghost")}).drop("_place")
    order = Window.partitionBy("_range").orderBy("_ghost", F.col("_key").desc(), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))\
        .filter("NOT _ghost").drop("_key", "_range", "_ghost")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def hashes(text: Column) -> Column:
        return F.transform(words_of(text), lambda w: F.xxhash64(w))

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Anchors are larger than their text, so texts are shuffled and anchors found after that.
    pairs = with_next(docs, ["text"])
    n = F.length("text").cast("long")
    lost = F.floor(n / 3).cast("int")
    edited = pairs.withColumn("n_chars", n).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), (n - lost).cast("int")), F.substring(F.col("next.text"), F.lit(1), lost)))
    names = ("own", "edited", "next")
    hashed = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("text")).alias("own"),
        hashes(F.col("edited")).alias("edited"), hashes(F.col("next.text")).alias("next"))
    counted = hashed.select("*", *[F.size(c).alias(f"{c}_words") for c in names])\
        .withColumns({f"{c}_bits": place_bits(F.col(f"{c}_words")) for c in names})
    found = counted.withColumns({c: anchors_of(F.col(c), F.col(f"{c}_bits")) for c in names})

    def like(other: str) -> Column:
        return likeness(F.col("own"), F.col(other), F.col("own_words"), F.col(f"{other}_words"))

    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next").alias("near_next"))
