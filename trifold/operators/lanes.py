"""Matchups of single picks: what the sum of fitted counters cannot express.

A pick's lane score is the sum of its counter weights against the other team.
A second stage fits weights of team features of the lane scores on top of a
model's z, which stays frozen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import pair_index, sigmoid
from trifold.sources.bind import N


def with_lanes(drafts: DataFrame, coefficients: DataFrame, n: int = N) -> DataFrame:
    """Adds lane_a and lane_b; coefficients: feature (ctr:pair) and beta, n * (n - 1) / 2 pairs at most."""
    own = coefficients.where(F.col("feature").startswith("ctr:"))
    w = [0.0] * (n * (n - 1) // 2)
    for r in own.select(F.split("feature", ":")[1].cast("int").alias("k"), "beta").collect():  # parameters, not rows
        w[r["k"]] = r["beta"]
    held = F.broadcast(drafts.sparkSession.createDataFrame([(w,)], "_c array<double>"))
    at = lambda i, j: F.element_at("_c", (pair_index(i, j, n) + 1).cast("int"))
    against = lambda x, y: F.when(x < y, at(x, y)).when(x > y, -at(y, x)).otherwise(0.0)
    lanes = lambda us, them: F.transform(us, lambda x: F.aggregate(them, F.lit(0.0), lambda acc, y: acc + against(x, y)))
    return drafts.crossJoin(held).withColumns({"lane_a": lanes("a", "b"), "lane_b": lanes("b", "a")}).drop("_c")


def _spread(v) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)
    return F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda acc, x: acc + x) / F.size(v)


def _both(f) -> Column:
    return f("lane_a") - f("lane_b")


#: Differences of the teams' features.
FEATURES = {
    "worst": lambda: [_both(F.array_min)],
    "best": lambda: [_both(F.array_max)],
    "variance": lambda: [_both(_spread)],
    "range": lambda: [_both(lambda v: F.array_max(v) - F.array_min(v))],
    "losing": lambda: [_both(lambda v: F.size(F.filter(v, lambda x: x < 0)).cast("double"))],
    "worst+variance": lambda: [_both(F.array_min), _both(_spread)],
}


def offset_fit(scored: DataFrame, features: list[Column], penalty: float = 1.0, steps: int = 15, w: str | None = None) -> list[float]:
    """Weights of the features beside the frozen z, under penalty / 2 * w^2; Newton steps, each one aggregate.

    ``w``: how many matches a row stands for, of which y is then the mean."""
    many, w = F.col(w) if w else F.lit(1.0), np.zeros(len(features))
    for _ in range(steps):
        z = F.col("z")
        for k, f in zip(w, features, strict=True):
            z = z + F.lit(float(k)) * f
        p = sigmoid(z)
        first = [F.sum(many * (p - F.col("y")) * f) for f in features]
        second = [F.sum(many * p * (1 - p) * f * g) for f in features for g in features]
        got = np.array([x or 0.0 for x in scored.agg(*[c.alias(f"s{k}") for k, c in enumerate(first + second)]).first()])
        g, h = got[: len(w)], got[len(w) :].reshape(len(w), len(w))
        step = np.linalg.solve(h + penalty * np.eye(len(w)), g + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def chance(features: list[Column], w: list[float]) -> Column:
    """p from z and the weighted features."""
    z = F.col("z")
    for k, f in zip(w, features, strict=True):
        z = z + F.lit(k) * f
    return sigmoid(z)


def second_stage(scored: DataFrame, features: list[Column], w: list[float]) -> DataFrame:
    """``scored`` with p from z and the weighted features."""
    return scored.withColumn("p", chance(features, w))
