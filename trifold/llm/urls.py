"""URL filters by a Bloom filter cascade.

A rule is an action, a host and the beginning of a path.  Each URL yields the
keys that could be listed: every suffix of its host with every beginning of its
path that has the length of some rule's.  Over all keys of the corpus, level 1
of a cascade encodes the listed keys, level 2 the keys that level 1 takes for
listed by mistake, level 3 the listed ones that level 2 takes for mistakes, and
so on until none is left.  The levels then tell every key of that universe
exactly, as constants inside one expression, without a join.  DataFrame
functions only.

Levels are broadcast as literals of MOST_BYTES at most; longer lists are
looked up by a join instead.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; of fitting rules the longest wins, then the one that sorts
first; a url without a rule is allowed, since it isn't listed; repeated rows
are judged alike; an empty table gives no rows; an empty list allows all.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Action, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MOST_BYTES = 16 << 20
#: Lists up to so many keys are broadcast while the levels are built.
FEW = 100_000


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path, which replace columns of these names."""
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that could be listed, the longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    ranked = F.array_sort(F.transform(pairs, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k"))))
    return F.transform(ranked, lambda x: x["k"])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))


class Level:
    """One Bloom filter: its bits as bytes, and how many hashes set them."""

    def __init__(self, bits: bytes, hashes: int):
        self.bits, self.hashes, self.size = bits, hashes, len(bits) * 8

    @staticmethod
    def places(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + j)), F.lit(size)) for j in range(hashes)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, salt: int) -> Level:
        """Of the column ``key``, sized for n keys and a share ``rate`` of mistakes; None if over MOST_BYTES."""
        hashes = max(1, round(-math.log2(rate)))
        size = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        if size > MOST_BYTES * 8:
            raise OverflowError(f"a level of {size} bits")
        place = keys.select(F.explode(F.array(*cls.places(F.col("key"), size, hashes, salt))).alias("p"))
        byte = place.groupBy((F.col("p") / 8).cast("long").alias("b")).agg(F.bit_or(_bit(F.col("p"))).alias("v"))
        out = bytearray(size // 8)
        for b, v in byte.collect():  # of a bounded number of bytes
            out[b] = v
        level = cls(bytes(out), hashes)
        level.salt = salt
        return level

    def has(self, key: Column) -> Column:
        bits = F.lit(bytearray(self.bits))
        found = []
        for p in self.places(key, self.size, self.hashes, self.salt):
            byte = F.conv(F.hex(F.substring(bits, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found.append(byte.bitwiseAND(_bit(p)) != 0)
        out = found[0]
        for x in found[1:]:
            out = out & x
        return out


class Cascade:
    """Exact membership of ``listed`` among ``universe``, both with a column ``key``."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = durable(listed.select("key").distinct())
        n = listed.count()
        other = durable(universe.select("key").distinct().join(F.broadcast(listed) if n <= FEW else listed, "key", "left_anti"))
        self.levels: list[Level] = []
        m = other.count()
        rate = min(0.5, max(2**-20, n * math.sqrt(0.5) / m)) if m else 0.5
        inside, outside = listed, other
        while n:
            level = Level.build(inside, n, rate, len(self.levels))
            self.levels.append(level)
            inside, outside = durable(outside.where(level.has(F.col("key")))), inside
            n, rate = inside.count(), 0.5

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].has(key), F.lit(i % 2 == 0)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict, which replace columns of these names."""
    spark = pages.sparkSession
    pages = with_host(pages)
    none = pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    if not rules:
        return none
    lengths = sorted({len(path) for _, _, path in rules})
    keys = keys_of(F.col("host"), F.col("path"), lengths)
    listed = spark.createDataFrame([(host + path, action) for action, host, path in rules], "key string, action string")
    try:
        cascade = Cascade(listed, pages.select(F.explode(keys).alias("key")).distinct())
        blocks = Cascade(listed.where("action = 'block'"), listed)
    except OverflowError:
        return _by_join(pages, keys, listed)
    rule = F.filter(keys, cascade.has)
    rule = F.when(F.size(rule) > 0, F.element_at(rule, 1))
    return pages.withColumn("rule", rule).withColumn("verdict", F.when(F.col("rule").isNotNull() & blocks.has(F.col("rule")), "block").otherwise("allow"))


def _by_join(pages: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """For lists beyond a broadcast: the distinct hosts and paths look their keys up by a shuffled join."""
    asked = pages.select("host", "path").distinct().withColumn("key", F.explode(keys))
    best = F.min(F.struct((-F.char_length("key")).alias("n"), "key", "action"))
    found = asked.join(listed.hint("merge"), "key").groupBy("host", "path").agg(best.alias("x")).select("host", "path", F.col("x.key").alias("rule"), F.col("x.action").alias("verdict"))
    return pages.join(found.hint("merge"), ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = {
    "op9_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost || rpath) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
