"""Allow and block rules for urls, kept in cascades of Bloom filters.

A rule is a host and a path prefix. The keys that could fit a url are its host's suffixes with its
path's prefixes, of just the numbers of labels and characters that rules have; all such keys of
the corpus are the key universe. The first level of a cascade encodes the listed keys, the second
the keys of the universe that pass the first though not listed, the third the listed keys that
pass the second, and so on until no key is told wrongly. Membership of a key is then exact for the
whole universe, and a url is judged by bit tests on constants: no join. The first level's size is
chosen by the classic trade-off from both counts, so a cascade takes about
``listed * log(universe / listed)`` bits, whatever the corpus.

The longest fitting rule wins (host and path together; then the longer host; then the text that
sorts first). A url that no rule fits gets the default verdict, allow: its keys are on no list.

A null url, or one without ``://``, has an empty host and path and no rule. Null page_id is passed
on, repeated rows give repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import cut_lineage

#: Bits of one bitmap of Spark's bitmap functions.
_BITMAP = 32_768


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
         Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _shapes(rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path), the longest first."""
    return sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)


def _candidate(shape: tuple[int, int], host: Column, path: Column) -> Column:
    """The url's key of this shape, null if it has none."""
    labels, size = shape
    enough = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= size) & (host != "")
    return F.when(enough, _key(F.substring_index(host, ".", -labels), F.substring(path, 1, size)))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    data: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        out = F.lit(True)
        for place in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), (F.expr("1") + F.floor(place / 8)).cast("int"), F.lit(1))), 16, 10)
            out = out & (F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1)
        return out


def _level(keys: DataFrame, n: int, share: float, seed: int) -> Level:
    """A filter over ``n`` keys that lets about ``share`` of all others pass."""
    bits = max(64, math.ceil(-n * math.log(share) / math.log(2) ** 2))
    bits = -(-bits // 8) * 8
    level = Level(bits, max(1, round(bits / n * math.log(2))), seed, b"")
    places = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("place"))
    maps = places.groupBy(F.floor(F.col("place") / _BITMAP).alias("part")).agg(
        F.bitmap_construct_agg(F.col("place") % _BITMAP).alias("map")).collect()
    data = bytearray(-(-bits // _BITMAP) * _BITMAP // 8)
    for part, bitmap in maps:
        data[part * _BITMAP // 8:(part + 1) * _BITMAP // 8] = bitmap
    return Level(bits, level.hashes, seed, bytes(data[:bits // 8]))


def cascade(listed: DataFrame, universe: DataFrame, most: int = 40) -> list[Level]:
    """Levels that tell the listed keys among the universe (both: distinct ``key``)."""
    inside = cut_lineage(listed.join(universe, "key", "left_semi"))
    n, total = inside.count(), universe.count()
    if not n:
        return []
    share = min(0.5, n / (math.sqrt(2) * max(1, total - n)))
    levels = [_level(inside, n, share, 1)]
    right = inside
    wrong = universe.join(inside, "key", "left_anti").filter(levels[0].passes(F.col("key")))
    while True:
        wrong = cut_lineage(wrong)
        n = wrong.count()
        if not n:
            return levels
        if len(levels) == most:
            raise ValueError("the cascade does not end; are keys repeated?")
        level = _level(wrong, n, 0.5, len(levels) + 1)
        levels.append(level)
        right, wrong = wrong, right.filter(level.passes(F.col("key")))


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for every key of the universe: odd levels hold listed keys, even ones the others."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for at in range(len(levels) - 1, -1, -1):
        out = F.when(levels[at].passes(key), out).otherwise(F.lit(at % 2 == 1))
    return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page's url."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        host_of(F.col("url").cast("string")).alias("host"),
                        path_of(F.col("url").cast("string")).alias("path"))
    shapes = _shapes(rules)
    keys = [_candidate(s, F.col("host"), F.col("path")) for s in shapes]
    universe = rows.select("host", "path").distinct()\
        .select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()
    universe = cut_lineage(universe)
    fits: list[tuple[int, int, str, Column, Column]] = []
    for verdict in sorted({r.verdict for r in rules}):
        mine = [r for r in rules if r.verdict == verdict]
        listed = spark.createDataFrame([(f"{r.host}\n{r.path}",) for r in mine], "key string").distinct()
        levels = cascade(listed, universe)
        for labels, size in _shapes(mine):
            key = _candidate((labels, size), F.col("host"), F.col("path"))
            fits.append((labels, size, verdict, key, key.isNotNull() & member(key, levels)))
    found = F.array_compact(F.array(*[
        F.when(hit, F.struct(
            (-(F.length(key) - 1)).alias("long"), (-F.length(F.substring_index(key, "\n", 1))).alias("host"),
            F.translate(key, "\n", "").alias("rule"), F.lit(verdict).alias("verdict")))
        for _, _, verdict, key, hit in fits]))
    best = rows.withColumn("best", F.array_min(found))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
