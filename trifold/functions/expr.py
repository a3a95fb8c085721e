"""Pure column expressions: identity, statistics and domain scores.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def n_rows() -> Column:
    return F.count(F.lit(1))


# Identity


def norm_tag(tag) -> Column:
    """Trimmed, upper-case, with one leading #; null if nothing is left."""
    marked = F.concat(F.lit("#"), F.ltrim(F.upper(F.trim(_c(tag))), F.lit("#")))
    return F.when(marked != "#", marked)


def match_key(time, tags) -> Column:
    """The same for every perspective on a match: SHA-1 of its time and its sorted tags."""
    return F.sha1(F.concat_ws("|", _c(time), F.array_join(F.sort_array(F.transform(_c(tags), norm_tag)), ",")).cast("binary"))


def winner(result, trophy_change, my_team) -> Column:
    """The winning team as an index, seen from one team; null for a draw or if it can't be told."""
    other = 1 - _c(my_team)
    change = _c(trophy_change)
    by_change = F.when(change > 0, _c(my_team)).when(change < 0, other)
    return F.when(_c(result) == "victory", _c(my_team)).when(_c(result) == "defeat", other).when(_c(result).isNull(), by_change)


def name_key(name) -> Column:
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]", "")


def compact_timestamp(text) -> Column:
    """Of texts such as 20260804T131108.000Z; null for others."""
    return F.try_to_timestamp(_c(text), F.lit("yyyyMMdd'T'HHmmss.SSS'Z'"))


def pair_index(i, j, n: int = 107) -> Column:
    """Dense number of the unordered pair among n things, from 0."""
    low, high = F.least(_c(i), _c(j)), F.greatest(_c(i), _c(j))
    return (low * (2 * n - low - 1) / 2).cast("long") + (high - low - 1)


# Statistics


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(high)), F.lit(low))


def sigmoid(z) -> Column:
    """Stable for large |z|."""
    z = _c(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def wilson(k, n, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the score interval for k of n."""
    k, n = _c(k), _c(n)
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


#: Abramowitz and Stegun 7.1.26: p, then the polynomial's coefficients from the first power on.  Fixed values.
ERF_P, ERF = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
#: Abramowitz and Stegun 26.2.17, likewise.
CDF_P, CDF = 0.2316419, [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def _polynomial(t: Column, coefficients: list[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = (out + c) * t
    return out


def erf(x) -> Column:
    x = _c(x)
    t = 1 / (1 + ERF_P * F.abs(x))
    return F.signum(x) * (1 - _polynomial(t, ERF) * F.exp(-x * x))


def norm_cdf(x) -> Column:
    x = _c(x)
    t = 1 / (1 + CDF_P * F.abs(x))
    tail = F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * _polynomial(t, CDF)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def decay(age, half_life) -> Column:
    return F.pow(F.lit(0.5), _c(age) / _c(half_life))


def share_error(p, n, slots: int = 6) -> Column:
    """Standard error of a share of n matches' picks."""
    return F.sqrt(_c(p) * (1 - _c(p)) / (slots * _c(n)))


# The adaptive poll loop


def priority(activity, tier, overdue_s, redundancy) -> Column:
    """Weighted sum of saturating terms; redundancy counts against."""
    hours = F.least(F.greatest(_c(overdue_s) / 3600, F.lit(0.0)), F.lit(24.0))
    return 1.0 * _c(activity) + 0.8 * _c(tier) + 0.5 * hours - 1.2 * _c(redundancy)


def explore_share(active, target) -> Column:
    """Budget share for finding new keys: 0.20 when empty, 0.05 when saturated, linear between."""
    filled = F.least(_c(active) / _c(target), F.lit(1.0))
    return F.round(0.2 - 0.15 * filled, 3)


def activity(old, new_per_hour) -> Column:
    return 0.7 * _c(old) + 0.3 * _c(new_per_hour)


#: First rank of each tier; the last that doesn't exceed a rank names it.
TIERS = [(1, "bronze"), (4, "silver"), (7, "gold"), (10, "diamond"), (13, "mythic"), (16, "legendary"), (19, "masters"), (22, "pro")]


def tier(rank, tiers: list[tuple[int, str]] = TIERS) -> Column:
    out = F.lit(None).cast("string")
    for first, name in tiers:
        out = F.when(_c(rank) >= first, name).otherwise(out)
    return out


# Random numbers that depend on seed and position alone


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once; written out, the nested uses would grow exponentially."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _multiply(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two numbers below 2**32, without overflow of 64 bits."""

    def parts(a: Column, b: Column) -> Column:
        low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
        top = (a * high).bitwiseAND(F.lit(0xFFFF)) * 65536
        return (a * low + top).bitwiseAND(F.lit(0xFFFFFFFF))

    return _let(a, lambda x: _let(b, lambda y: parts(x, y)))


def uniform(seed: int, k) -> Column:
    """Draw k (from 0) of the mulberry32 generator: its state is a counter, so every draw stands alone."""
    mask = F.lit(0xFFFFFFFF)
    state = _multiply((_c(k).cast("long") + 1).bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))
    first = lambda t: _multiply(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1).cast("long")))
    more = lambda t: _multiply(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))
    t = _let((state + F.lit(seed).cast("long")).bitwiseAND(mask), first)
    t = _let(t, lambda t: t.bitwiseXOR((t + more(t)).bitwiseAND(mask)))
    return _let(t, lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14))) / F.lit(4294967296.0)


def p_of_interval(value, low, high) -> Column:
    """Two-sided normal p-value of a value against 0, its standard error read off a 95 % interval; 1 for an interval without width."""
    value, low, high = (F.col(x) if isinstance(x, str) else x for x in (value, low, high))
    error = (high - low) / 3.92
    z = F.when(error > 0, F.abs(value) / error).otherwise(0.0)
    return 1 - erf(z / F.sqrt(F.lit(2.0)))
