"""Quality of predicted probabilities: p between 0 and 1, y 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import clamp
from trifold.operators.ranking import equal_count_bin, row_number, running_before


def log_loss(p="p", y="y"):
    q = clamp(p, 1e-9, 1 - 1e-9)
    return -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def losses(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """``w``: how many rows a row stands for, of which y is then the mean."""
    if w:
        square = F.pow(F.col(p) - F.col(y), 2) + F.col(y) * (1 - F.col(y))  # that of rows whose y is 0 or 1
        mean = lambda x: F.try_divide(F.sum(F.col(w) * x), F.sum(w))
        return df.agg(mean(log_loss(p, y)).alias("log_loss"), mean(square).alias("brier"), F.coalesce(F.round(F.sum(w)), F.lit(0)).cast("long").alias("n"))
    return df.agg(F.avg(log_loss(p, y)).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Share of pairs in the right order, ties half; null if a class is missing.

    Counts per distinct p, then the negatives below each: the rows themselves are never sorted.
    ``w``: how many rows a row stands for, of which y is then the mean."""
    count = lambda x: (F.round(F.sum(F.col(w) * x)) if w else F.sum(x)).cast("long")
    by = df.groupBy(p).agg(count(F.col(y)).alias("pos"), count(1 - F.col(y)).alias("neg"))
    placed = running_before(by, [F.col(p)], ["neg"])
    # As a sum of doubles: pairs outgrow a long at some 10^9 rows of each class.
    hits = F.sum(F.col("pos").cast("double") * (2.0 * F.col("before_neg") + F.col("neg")))
    pos, neg = F.sum("pos"), F.sum("neg")
    return placed.agg(F.try_divide(hits, 2.0 * pos.cast("double") * neg).alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def auc_interval(df: DataFrame, p: str = "p", y: str = "y", z: float = 1.96) -> DataFrame:
    """``auc`` with a normal interval from the variances of both classes' placements among the other."""
    by = df.groupBy(p).agg(F.sum(F.col(y)).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    placed = running_before(by, [F.col(p)], ["pos", "neg"])
    n_pos, n_neg = (float(x or 0) for x in by.agg(F.sum("pos"), F.sum("neg")).first())
    up = F.try_divide(F.col("before_neg") + F.col("neg") / 2, F.lit(n_neg))  # of a positive: the share of negatives below
    down = 1 - F.try_divide(F.col("before_pos") + F.col("pos") / 2, F.lit(n_pos))
    mean = F.try_divide(F.sum(F.col("pos") * up), F.lit(n_pos))
    spread = lambda n, x, total: F.try_divide(F.try_divide(F.sum(n * x * x) - total * mean * mean, F.lit(max(total - 1, 0.0))), F.lit(total))
    error = F.sqrt(F.greatest(spread(F.col("pos"), up, n_pos) + spread(F.col("neg"), down, n_neg), F.lit(0.0)))
    return placed.agg(mean.alias("auc"), (mean - z * error).alias("low"), (mean + z * error).alias("high"), F.lit(int(n_pos)).cast("long").alias("n_pos"), F.lit(int(n_neg)).cast("long").alias("n_neg"))


def calibration(df: DataFrame, key: str, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Equal-count bins in order of p: count, mean p and share of y."""
    n = df.count()
    rows = row_number(df, [F.col(p), F.col(key)]).withColumn("bin", equal_count_bin(F.col("rn"), n, bins))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("share"))


def ece(reliability: DataFrame) -> DataFrame:
    """Expected calibration error of ``calibration``'s bins."""
    return reliability.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))
