"""Ranks, running sums and equal-count cuts over a whole table, without sending it to one task.

A global window would sort everything in one task.  Here the rows are dealt out
by ranges of the order, numbered within each range, and shifted by the counts
of the ranges before, of which there is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trifold.session import durable, small


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    # Checkpointed, since ranges are sampled and must not change between the two uses.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Per range, the sums over the ranges before it; one row per task goes through one window."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_b_{c}") for c in sums])


def row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with its place in the order, from 1."""
    rows = _ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_local", local).join(F.broadcast(_before(counts, ["n"])), "_part").withColumn(name, F.col("_b_n") + F.col("_local")).drop("_part", "_local", "_b_n")


def running_before(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with before_<column>, the sum over all earlier rows; the order must be unique."""
    rows = _ranged(df, order)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(_before(totals, sums)), "_part")
    return out.select("*", *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_b_{c}")).alias(f"before_{c}") for c in sums]).drop("_part", *[f"_b_{c}" for c in sums])


def last_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the last ``value`` that isn't null up to each row in the order; each range takes on what the ones before it end with."""
    rows = _ranged(df, order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last(value, ignorenulls=True).over(w))
    known = rows.where(F.col(value).isNotNull())
    ends = known.groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    parts = rows.select("_part").distinct().join(ends, "_part", "left")  # one row per task
    carried = F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    out = own.join(F.broadcast(parts.select("_part", carried.alias("_carried"))), "_part")
    return out.withColumn(name, F.coalesce("_own", "_carried")).drop("_part", "_own", "_carried")


def equal_count_bin(rn: Column, n: int, k: int) -> Column:
    """Bin of row rn (from 1) among k bins whose edges are floor(f * n / k)."""
    return F.floor((rn * k - 1) / F.lit(n)).cast("int")


def forward_fold(rn: Column, n: int, k: int) -> Column:
    """Fold of a row in order of time; a split trains on the folds before."""
    return equal_count_bin(rn, n, k)


def _placed(df: DataFrame, value: str, keys: list[str], count: str | None = None) -> DataFrame:
    """Each key's distinct values with the places _from (inclusive) to _to (exclusive) that they take among its _total rows.

    Equal values are counted first; ``count`` names a column that says how often a row stands.  All keys are ranged together, so that no
    key's values meet in one task, and a key's first place is then taken off."""
    counts = df.groupBy(*keys, value).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    rows = running_before(counts, [F.col(c) for c in [*keys, value]], ["_n"])
    if not keys:
        total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"), F.lit(0).alias("_first"))
        rows = rows.crossJoin(F.broadcast(total))
    else:
        of = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in keys]).agg(F.sum("_n").alias("_total"), F.min("before__n").alias("_first"))
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
        rows = rows.join(small(of), same)
    first = F.col("before__n") - F.col("_first")
    return rows.select(*keys, value, "_total", first.alias("_from"), (first + F.col("_n")).alias("_to"))


def order_statistic(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """Values at place floor(p * (n - 1)) in ascending order, without interpolation."""
    keys = keys or []
    asked = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("p")
    rows = _placed(df, value, keys).select(*keys, value, "_from", "_to", "_total", asked)
    at = F.floor(F.col("p") * (F.col("_total") - 1))
    return rows.where((at >= F.col("_from")) & (at < F.col("_to"))).select(*keys, "p", value)


def median(df: DataFrame, value: str, keys: list[str], name: str = "median", count: str | None = None) -> DataFrame:
    """The middle value of each key's rows, of an even number the mean of the two; nulls don't count."""
    rows = _placed(df.where(F.col(value).isNotNull()), value, keys, count)
    middle = F.explode(F.array(F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2))).alias("_at")
    both = rows.select(*keys, value, "_from", "_to", middle).where("_at >= _from AND _at < _to")
    return both.groupBy(*keys).agg(F.avg(value).alias(name))


def top_share(df: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """Share of all rows that the k most frequent keys have."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), key).limit(max(ks))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # max(ks) rows
    rows = ranked.crossJoin(F.broadcast(total)).select("rank", "n", "total", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return rows.where("rank <= k").groupBy("k").agg((F.sum("n") / F.first("total")).alias("share"))


def zipf_exponent(df: DataFrame, key: str) -> DataFrame:
    """Minus the slope of log share on log rank over the keys' frequencies."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    ranked = row_number(counts, [F.desc("n"), F.col(key)], "rank")
    return ranked.agg((-F.regr_slope(F.log(F.col("n") / total), F.log("rank"))).alias("zipf"), F.count(F.lit(1)).alias("n_keys"))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) over ranks without ties, which ``key`` breaks."""
    both = row_number(row_number(df, [F.col(x), F.col(key)], "rx"), [F.col(y), F.col(key)], "ry")
    d = F.sum(F.pow(F.col("rx") - F.col("ry"), 2))
    n = F.count(F.lit(1))
    x = n.cast("double")  # its cube is beyond a long from some two million rows on
    return both.agg((1 - F.try_divide(6 * d, x * (x * x - 1))).alias("rho"), n.alias("n"))


def false_discovery(df: DataFrame, p: str, key: str, q: float = 0.05) -> DataFrame:
    """``df`` with its place by p, and whether it passes the step-up procedure and the Bonferroni bound."""
    m = df.count()
    ranked = row_number(df, [F.col(p), F.col(key)], "place")
    cut = ranked.where(F.col(p) <= F.lit(q) * F.col("place") / m).agg(F.coalesce(F.max("place"), F.lit(0)).alias("_cut"))
    return ranked.crossJoin(F.broadcast(cut)).withColumn("fdr", F.col("place") <= F.col("_cut")).withColumn("bonferroni", F.col(p) < q / max(m, 1)).drop("_cut")


def dense_first_seen(df: DataFrame, key: str, time: str) -> DataFrame:
    """Numbers from 0 for the values of ``key`` in the order of their first time."""
    first = df.groupBy(key).agg(F.min(time).alias("first_seen"))
    return row_number(first, [F.col("first_seen"), F.col(key)], "id").withColumn("id", F.col("id") - 1)
