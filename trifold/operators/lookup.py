"""Joins: intervals, positions, names, and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trifold.functions.expr import name_key
from trifold.operators import ranking
from trifold.session import small


#: Up to so many segments are joined as one array.
FEW_SEGMENTS = 1000


def interval(df: DataFrame, segments: DataFrame, time: str, columns: list[str], most: int = FEW_SEGMENTS) -> DataFrame:
    """``df`` with ``columns`` of the segment with start <= time < stop (null: open), or null.

    Segments don't overlap; of those that begin together the one that sorts last
    counts.  Their number is checked: up to ``most`` go out as one sorted array,
    which shuffles nothing; more of them are carried along the order of time."""
    if segments.count() > most:
        return _carried(df, segments, time, columns)
    fields = ["start", "stop", *columns]
    one = segments.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_segments"))
    fits = F.filter("_segments", lambda s: (s["start"] <= F.col(time)) & (s["stop"].isNull() | (s["stop"] > F.col(time))))
    out = df.crossJoin(F.broadcast(one)).withColumn("_hit", F.try_element_at(fits, F.lit(-1)))
    return out.select(*df.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns])


def _carried(df: DataFrame, segments: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Rows and segments in one order, by ranges, each row with the last segment before it.

    Rows of one time are spread over ranges by a drawn number, for segments go before them anyway."""
    kind = dict(df.dtypes)[time]
    starts = segments.select(F.col("start").cast(kind).alias("_t"), F.struct("start", "stop", *columns).alias("_segment"), F.lit(0.0).alias("_place"))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(time).alias("_t"), (F.rand(1) + 1).alias("_place"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    out = ranking.last_before(both, [F.col("_t"), F.col("_place"), F.col("_segment")], "_segment", "_hit").where("_row IS NOT NULL")
    fits = F.col("_t").isNotNull() & (F.col("_hit.stop").isNull() | (F.col("_hit.stop") > F.col("_t")))
    return out.select("_row.*", *[F.when(fits, F.col(f"_hit.{c}")).alias(c) for c in columns])


def preceding(df: DataFrame, keys: list[str], position: str, is_anchor: Column, value: str, name: str) -> DataFrame:
    """``df`` with ``value`` of the last anchor row before each row of its group."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(w))


def by_name(df: DataFrame, name: str, dimension: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with the id of its name: by the plain key first, then by an alias.

    dimension: id, name; aliases: alias, id.  Both are checked before they are broadcast."""
    plain = small(dimension.groupBy(name_key("name").alias("_k")).agg(F.min("id").alias("_id")))
    other = small(aliases.groupBy(name_key("alias").alias("_k")).agg(F.min("id").alias("_alias")))
    out = df.withColumn("_k", name_key(name)).join(plain, "_k", "left").join(other, "_k", "left")
    return out.withColumn("id", F.coalesce("_id", "_alias")).drop("_k", "_id", "_alias")


def unmatched(df: DataFrame, name: str, known: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent names without a partner in ``known`` (column name)."""
    keys = known.select(name_key("name").alias("_k")).distinct()
    rows = df.withColumn("_k", name_key(name)).join(keys, "_k", "left_anti")
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(top)


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Insert-or-replace: the row with the highest version of each key."""
    rest = [c for c in df.columns if c not in {*keys, *version}]
    best = F.max(F.struct(*version, *rest)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*version, *rest]])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` whose key ``old`` lacks, the first of each key by all columns."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return first.join(old.select(*keys).distinct(), keys, "left_anti")


def observed(log: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Insert-or-increment: per key the first observation's values, and how often it was seen."""
    first = F.min(F.struct(time, *values)).alias("_f")
    return log.groupBy(key).agg(first, F.count(F.lit(1)).alias("seen_count")).select(key, "seen_count", F.col(f"_f.{time}").alias(time), *[F.col(f"_f.{v}").alias(v) for v in values])


def overwrite(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Update-by-key: columns of ``changes`` that aren't null replace the old ones."""
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys])
    put = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in changes.columns if c not in keys}
    return old.join(new, keys, "left").withColumns(put).select(*old.columns)


def overlap_at(a: DataFrame, b: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """Per group, the share of the first k of ``a`` that are among the first k of ``b``; both have a rank."""
    x, y = a.where(F.col("rank") <= k).select(*keys, item), b.where(F.col("rank") <= k).select(*keys, item, F.lit(1).alias("_in"))
    return x.join(y, [*keys, item], "left").groupBy(*keys).agg((F.sum(F.coalesce("_in", F.lit(0))) / k).alias("overlap"))


def watermarks(rows: DataFrame, key: str, time: str, seen: str) -> DataFrame:
    """Per key its newest ``time``, and how many of its rows were ``seen`` later than that.

    Rows are counted by key and time of being seen first, so a hot key takes its distinct times only."""
    counts = rows.groupBy(key, seen).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("newest"))
    newest = counts.groupBy(key).agg(F.max("newest").alias("watermark"))
    both = counts.join(newest, key)
    later = F.sum(F.when(F.col(seen) > F.col("watermark"), F.col("n")).otherwise(0))
    return both.groupBy(key, "watermark").agg(later.alias("later"))
