"""Sample sizes: how many matches a joint test of df parameters needs, and each pair's own coefficient.

The laws are plain numerics over a few numbers; pairs are spread over tasks."""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.operators import ranking
from trifold.session import durable


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - log_gamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - log_gamma(a)) * h


def chi2_cdf(x: float, df: float) -> float:
    return lower_gamma(df / 2, x / 2)


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def chi2_quantile(q: float, df: float) -> float:
    return bisect(lambda x: chi2_cdf(x, df) - q, 0, df + 40 * math.sqrt(df) + 100)


def power(df: float, noncentrality: float, alpha: float) -> float:
    """Of the chi-square test, the noncentral law taken as a scaled central one."""
    h, c = df + noncentrality, (df + 2 * noncentrality) / (df + noncentrality)
    return 1 - chi2_cdf(chi2_quantile(1 - alpha, df) / c, h / c)


def matches_needed(df: float, variance: float, alpha: float, goal: float = 0.8) -> int:
    """Least n whose noncentrality n * variance / 4 reaches the power."""
    return math.ceil(bisect(lambda n: power(df, n * variance / 4, alpha) - goal, 1, 1e9, 80))


def sigma_from_auc(auc: float) -> float:
    """Spread of true scores (logits, normal) at which the best ranking has this AUC."""
    x, w = np.polynomial.hermite_e.hermegauss(80)
    w = w / w.sum()

    def expected(s: float) -> float:
        p = 1 / (1 + np.exp(-s * x))
        won, lost = w * p / (w @ p), w * (1 - p) / (w @ (1 - p))
        below = np.cumsum(lost) - lost / 2
        return float(won @ below)

    return bisect(lambda s: expected(s) - auc, 1e-6, 20, 60)


def accuracy(sigma: float) -> float:
    """Share of right calls of the best predictor where true scores are normal with this spread."""
    x = np.linspace(-9, 9, 20_001)
    w = np.exp(-x * x / 2)
    return float(w @ (1 / (1 + np.exp(-sigma * np.abs(x)))) / w.sum())


def sigma_from_accuracy(goal: float) -> float:
    return bisect(lambda s: accuracy(s) - goal, 1e-6, 20, 80)


class Game(NamedTuple):
    """How many slots, ordered pairs of allies and pairs of opponents a match has."""

    slots: int
    allies: int
    opponents: int


class Terms(NamedTuple):
    """Spread of one strength, one synergy and one counter, in log odds."""

    solo: float
    synergy: float
    counter: float


#: Published quality of draft models of a game of five against five, and the two games' sizes.
SOLO_ACCURACY, FULL_AUC = 0.58, 0.660
FIVE, THREE = Game(10, 20, 25), Game(6, 6, 9)
#: Fixed value: by how much a pair's variance grows for the strengths beside it.
INFLATION = 1.5


def terms(solo_accuracy: float = SOLO_ACCURACY, full_auc: float = FULL_AUC, game: Game = FIVE, synergy_share: float = 0.5) -> Terms:
    """Spreads of single terms, from how well strengths alone and a whole model predict.

    What the whole model has beyond strengths is shared out between synergies and counters."""
    solo = sigma_from_accuracy(solo_accuracy) ** 2
    rest = max(0.0, sigma_from_auc(full_auc) ** 2 - solo)
    return Terms(*(round(math.sqrt(v / n), 6) for v, n in zip((solo, rest * synergy_share, rest * (1 - synergy_share)), game, strict=True)))


def transferred(one: Terms, source: Game = FIVE, target: Game = THREE, total: bool = False) -> Terms:
    """Terms for another game: as they are, or grown so that the family's variance over a match is kept (``total``)."""
    return Terms(*(round(t * math.sqrt(a / b), 6) if total else t for t, a, b in zip(one, source, target, strict=True)))


def coefficient_n(delta: float, alpha: float, goal: float = 0.8, inflation: float = INFLATION) -> float:
    """Occurrences at which a coefficient of this size is found with the power; its error is 2 / sqrt(n), inflated."""
    z = NormalDist().inv_cdf
    return 4 * inflation * (z(1 - alpha / 2) + z(goal)) ** 2 / delta**2


def pair_rates(shares: DataFrame) -> DataFrame:
    """Of all pairs of characters, how often a match has them as allies (12 q_i q_j) and as opponents (18 q_i q_j).

    shares: brawler_id and q, its share of all picks, checked for their number.
    Pairs are made from ranges of ids, so each is one row and none is made twice."""
    n = shares.count()
    if n > 5000:
        raise ValueError(f"{n} characters; at most 5000 are broadcast")
    order = F.broadcast(shares.agg(F.array_sort(F.collect_list(F.struct("brawler_id", "q"))).alias("_all")))
    numbered = shares.sparkSession.range(n).crossJoin(order).select(F.get("_all", F.col("id").cast("int")).alias("i"), F.explode(F.slice("_all", F.col("id").cast("int") + 2, n)).alias("j"))
    both = F.col("i.q") * F.col("j.q")
    return numbered.select(F.col("i.brawler_id").alias("i"), F.col("j.brawler_id").alias("j"), (12 * both).alias("synergy"), (18 * both).alias("counter"))


def pair_sizes(shares: DataFrame, scenarios: dict[str, Terms], n_matches: int, alpha: float, at: tuple[float, ...] = (0.5, 0.9), strong: float = 2.0) -> DataFrame:
    """Matches that single pairs need: for pairs at these places among all, in descending order of how often they meet.

    A pair is strong at ``strong`` spreads.  Per scenario, family and place: the
    effect, how often the pair meets in a match, the occurrences and matches
    needed (null if it never meets), where data outweigh the prior (half), and how many of all pairs
    have enough occurrences in ``n_matches`` matches."""
    rates = durable(pair_rates(shares))
    n = rates.count()
    spark, out = shares.sparkSession, None
    places = {p: min(n - 1, math.floor(p * n)) + 1 for p in at} if n else {}
    # Both families' rates are the shares' product times a number, so one order serves both.
    rank = ranking.row_number(rates, [F.desc("synergy"), F.col("i"), F.col("j")])
    wanted = spark.createDataFrame([(float(p), k) for p, k in places.items()], "place double, rn long")
    placed = durable(rank.join(F.broadcast(wanted), "rn").select("place", "synergy", "counter"))
    for family in ("synergy", "counter"):
        picked = placed.select("place", F.col(family).alias("rate"))
        for name, t in scenarios.items():
            size = getattr(t, family) * strong
            need = coefficient_n(size, alpha)
            enough = rates.agg(F.count_if(F.col(family) * F.lit(n_matches) >= F.lit(need)).alias("n_enough"), F.count(F.lit(1)).alias("n_pairs"))
            part = picked.crossJoin(F.broadcast(enough)).select(
                F.lit(name).alias("scenario"), F.lit(family).alias("family"), "place", F.lit(size).alias("delta"), "rate",
                F.lit(need).alias("occurrences"), F.try_divide(F.lit(need), "rate").alias("matches"), F.lit(4 / getattr(t, family) ** 2).alias("half"), "n_enough", "n_pairs",
            )
            out = part if out is None else out.unionByName(part)
    return out
