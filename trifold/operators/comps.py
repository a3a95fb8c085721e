"""Team compositions: roles, claims about them, and overlapping families of compositions."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import n_rows, wilson
from trifold.functions.text import composition_key
from trifold.sources.bind import CLASSES, class_of


def with_roles(sides: DataFrame) -> DataFrame:
    """Adds classes, comp, coverage (distinct classes) and redundancy (most picks of one class)."""
    classes = F.transform("team", class_of)
    most = F.array_max(F.transform(F.array_distinct("classes"), lambda c: F.size(F.filter("classes", lambda x: x == c))))
    df = sides.withColumn("classes", classes)
    return df.withColumns({"comp": composition_key("classes"), "coverage": F.size(F.array_distinct("classes")), "redundancy": most})


def win_rate(df: DataFrame, *keys, least: int = 1) -> DataFrame:
    """n, wins, rate and Wilson interval per key with ``least`` rows or more."""
    by = df.groupBy(*keys).agg(n_rows().alias("n"), F.sum("won").cast("long").alias("wins")).where(F.col("n") >= least)
    low, high = wilson("wins", "n")
    return by.withColumns({"rate": F.col("wins") / F.col("n"), "low": low, "high": high})


def two_arms(df: DataFrame, claims: list[tuple[str, Column, Column]], least: int = 20) -> DataFrame:
    """For each claim (id, scope, feature) the win rates with and without the feature, all in one pass.

    verdict compares the two intervals; diff has its own interval besides."""
    arms = []
    for name, scope, feature in claims:
        for arm, on in (("with", feature), ("without", ~feature)):
            arms.append(F.when(scope & on, F.struct(F.lit(name).alias("claim"), F.lit(arm).alias("arm"))))
    rows = df.select("won", F.explode(F.filter(F.array(*arms), lambda x: x.isNotNull())).alias("x")).groupBy("x.claim")
    n = lambda arm: F.sum((F.col("x.arm") == arm).cast("long"))
    k = lambda arm: F.sum(F.when(F.col("x.arm") == arm, F.col("won")).otherwise(0))
    out = rows.agg(n("with").alias("n1"), k("with").cast("long").alias("k1"), n("without").alias("n0"), k("without").cast("long").alias("k0"))
    (l1, h1), (l0, h0) = wilson("k1", "n1"), wilson("k0", "n0")
    p1, p0 = F.col("k1") / F.col("n1"), F.col("k0") / F.col("n0")
    error = F.sqrt(p1 * (1 - p1) / F.col("n1") + p0 * (1 - p0) / F.col("n0"))
    known = (F.col("n1") >= least) & (F.col("n0") >= least)
    said = F.when(~known, "too few").when(l1 > h0, "higher").when(h1 < l0, "lower").otherwise("overlap")
    both = F.when(known, p1 - p0)
    return out.select("claim", "n1", "k1", "n0", "k0", both.alias("diff"), (both - 1.96 * error).alias("diff_low"), (both + 1.96 * error).alias("diff_high"), said.alias("verdict"))


def families() -> list[tuple[str, str]]:
    """The catalogue: 84 multisets of three classes, 21 pairs present, 7 classes present."""
    short = sorted(c[:3] for c in CLASSES)
    triples = [("triple", "+".join(x)) for x in combinations_with_replacement(short, 3)]
    return triples + [("pair", "+".join(x)) for x in combinations(short, 2)] + [("single", x) for x in short]


def memberships(comp_classes: str = "classes") -> Column:
    """Every family that a composition belongs to; these overlap, so groups aren't grouping sets."""
    short = F.array_sort(F.transform(comp_classes, lambda c: F.substring(c, 1, 3)))
    unique = F.array_distinct(short)
    label = lambda family, value: F.struct(F.lit(family).alias("family"), value.alias("label"))
    single = F.transform(unique, lambda x: label("single", x))
    pair = F.flatten(F.transform(unique, lambda x, i: F.transform(F.slice(unique, i + 2, F.size(unique)), lambda z: label("pair", F.concat_ws("+", x, z)))))
    return F.concat(F.array(label("triple", F.array_join(short, "+"))), pair, single)


def family_residuals(rows: DataFrame, value: str = "residual", least: int = 1) -> DataFrame:
    """Count and mean of ``value`` per family and label over rows with classes."""
    each = rows.select(value, F.explode(memberships()).alias("m"))
    return each.groupBy("m.family", "m.label").agg(n_rows().alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)
