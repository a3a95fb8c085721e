"""Clustered resampling: intervals and p-values for means of groups.

Matches are the clusters: both team rows of a match share its weight in a
replicate.  The weight is drawn from a Poisson law of mean 1 by hashing the
match and the replicate, so replicates need neither a driver nor an order of
rows, and each task reduces its rows to one line per group before any shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import norm_cdf

#: Cumulative Poisson(1) law up to 8.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def _weights(cluster: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weights by cluster and replicate from 64 mixed bits."""
    h = cluster.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(replicates, dtype=np.uint64) + np.uint64(1))[None] * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    share, w = (h >> np.uint64(11)) / 2.0**53, np.zeros(h.shape, np.int8)
    for limit in POISSON:  # as searchsorted, in a third of the time
        w += share > limit
    return w


def _sums(replicates, seed):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            group = batch.column("grp").to_pylist()
            if not group:
                continue
            value, cluster = batch.column("value").to_numpy(zero_copy_only=False), batch.column("cluster").to_numpy(zero_copy_only=False)
            names, code = np.unique(np.array(group, dtype=object).astype(str), return_inverse=True)
            for a in range(0, len(value), 4096):
                own, back = np.unique(cluster[a : a + 4096], return_inverse=True)
                w = _weights(own, replicates, seed)[back]
                order = np.argsort(code[a : a + 4096], kind="stable")
                here = code[a : a + 4096][order]
                start = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
                both = np.concatenate([w, w * value[a : a + 4096, None]], axis=1)[order]
                for k, x in zip(here[start], np.add.reduceat(both, start, axis=0), strict=True):
                    total[names[k]] = total.get(names[k], 0) + x
        keys = sorted(total)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k][:replicates].tolist() for k in keys], pa.list_(pa.float64())), pa.array([total[k][replicates:].tolist() for k in keys], pa.list_(pa.float64()))], names=["grp", "n", "total"])

    return run


def group_means(rows: DataFrame, group: str, value: str, cluster: str, replicates: int = 200, seed: int = 20260805) -> DataFrame:
    """Per group: n, mean, standard error, percentile interval and p-value of its mean.

    The interval's ends are at floor(.025 B) and ceil(.975 B) - 1 of the B sorted
    replicates; p is twice the share of replicates on the smaller side of 0, 1 / B
    at least, and p_normal that of the mean over its standard error."""
    rows = rows.select(F.col(group).cast("string").alias("grp"), F.col(value).cast("double").alias("value"), F.xxhash64(cluster).alias("cluster"))
    each = rows.mapInArrow(_sums(replicates, seed), "grp string, n array<double>, total array<double>")
    means = each.select("grp", F.posexplode(F.arrays_zip("n", "total")).alias("b", "x")).groupBy("grp", "b").agg(F.try_divide(F.sum("x.total"), F.sum("x.n")).alias("m")).where("m IS NOT NULL")
    spread = means.groupBy("grp").agg(F.stddev_samp("m").alias("error"), F.array_sort(F.collect_list("m")).alias("_s"))
    size = F.size("_s")
    at = lambda place: F.element_at("_s", place.cast("int") + 1)
    below = F.size(F.filter("_s", lambda m: m <= 0))
    p = F.try_divide(F.greatest(2 * F.least(below, size - below), F.lit(1)), size)
    point = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    out = point.join(spread.select("grp", "error", at(F.floor(0.025 * size)).alias("low"), at(F.ceil(0.975 * size) - 1).alias("high"), p.alias("p")), "grp", "left")
    return out.withColumn("p_normal", 2 * (1 - norm_cdf(F.abs(F.try_divide("mean", "error"))))).withColumnRenamed("grp", group)


def _together(replicates, seed, k):
    """Sums of the weights, and of the weights times each of the values v0, v1, ..., by replicate: one line a task."""

    def run(batches):
        n, total = np.zeros(replicates), np.zeros((replicates, k))
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            for a in range(0, len(cluster), 2048):
                own, back = np.unique(cluster[a : a + 2048], return_inverse=True)
                w = _weights(own, replicates, seed).astype(float)
                rows, sums = np.bincount(back, minlength=len(own)), np.column_stack([np.bincount(back, values[a : a + 2048, i], minlength=len(own)) for i in range(k)])
                n += np.einsum("ir,i->r", w, rows)  # in the task's one thread
                total += np.einsum("ir,ik->rk", w, sums)
        yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.float64())), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    return run


def paired_differences(df: DataFrame, first: str, others: list[str], key: str, replicates: int = 400, alpha: float = 0.05, seed: int = 99, floor: float = 1e-4) -> list[tuple[int, float, float, float, bool]]:
    """For each of ``others``, the mean of first - other over paired rows with a bias-corrected and accelerated interval:
    rows, mean, low, high, matters; none if there are no rows.

    All are resampled with the same weights, which are drawn once.  The bias comes
    from the replicates below the mean, the acceleration from the differences'
    skewness, which is the jackknife's closed form for a mean.  ``matters`` asks for
    an interval off zero and a mean beyond ``floor``."""
    from trifold.operators.power import bisect

    k = len(others)
    d = df.select(F.xxhash64(key).alias("cluster"), *[(F.col(first) - F.col(c)).cast("double").alias(f"v{i}") for i, c in enumerate(others)])
    n, *points = d.agg(F.count(F.lit(1)), *[f(f"v{i}") for i in range(k) for f in (F.avg, F.skewness)]).first()
    parts = d.mapInArrow(_together(replicates, seed, k), "n array<double>, total array<double>")
    each = parts.select(F.posexplode("total").alias("b", "x"), "n").select("b", "x", F.element_at("n", F.floor(F.col("b") / k).cast("int") + 1).alias("n"))
    rows = each.groupBy("b").agg(F.try_divide(F.sum("x"), F.sum("n")).alias("m")).where("m IS NOT NULL").collect()  # one number per replicate and value
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    quantile = lambda p: bisect(lambda z: cdf(z) - p, -10, 10, 80)
    out = []
    for i in range(k if rows else 0):
        means, mean, skew = np.sort([r["m"] for r in rows if r["b"] % k == i]), points[2 * i], points[2 * i + 1]
        bias = quantile(min(max(float((means < mean).mean()), 1e-4), 1 - 1e-4))
        speed = (skew if skew is not None and math.isfinite(skew) else 0.0) / (6 * math.sqrt(max(n, 1)))

        def end(p: float) -> float:
            z = bias + quantile(p)
            q = cdf(bias + z / (1 - speed * z))
            return float(means[min(len(means) - 1, max(0, int(q * len(means))))])

        low, high = end(alpha / 2), end(1 - alpha / 2)
        out.append((int(n), float(mean), low, high, bool((low > 0 or high < 0) and abs(mean) >= floor)))
    return out


def paired_difference(df: DataFrame, first: str, second: str, key: str, replicates: int = 400, alpha: float = 0.05, seed: int = 99, floor: float = 1e-4) -> DataFrame:
    """``paired_differences`` of one column, as a row; no row if there are none to compare."""
    found = paired_differences(df, first, [second], key, replicates, alpha, seed, floor)
    return df.sparkSession.createDataFrame(found, "n long, delta double, low double, high double, matters boolean")
