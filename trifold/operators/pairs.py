"""Pairs and triples of picks.  All are made within a row, so matches are not shuffled to find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import pair_index


def same_team(team) -> Column:
    """The unordered pairs of a team as structs (i, j), i < j."""
    t = F.array_sort(F.col(team) if isinstance(team, str) else team)
    pair = lambda x, k: F.transform(F.slice(t, k + 2, F.size(t)), lambda z: F.struct(x.alias("i"), z.alias("j")))
    return F.flatten(F.transform(t, pair))


def cross_team(a: str, b: str) -> Column:
    """Ordered pairs of unequal picks of two teams, with sign 1 where ours has the lower number and -1 otherwise."""
    pair = lambda x: F.transform(F.filter(F.col(b), lambda z: z != x), lambda z: F.struct(x.alias("ours"), z.alias("theirs"), F.when(x < z, 1).otherwise(-1).alias("sign")))
    return F.flatten(F.transform(F.col(a), pair))


def triple(team: str) -> Column:
    return F.array_join(F.array_sort(team), ",")


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each team: team picks, opponents and whether it won."""
    side = lambda team, other, won, k: F.struct(F.lit(k).alias("side"), F.col(team).alias("team"), F.col(other).alias("other"), won.alias("won"))
    rows = matches.withColumn("_s", F.explode(F.array(side("a", "b", F.col("y"), 0), side("b", "a", 1 - F.col("y"), 1))))
    return rows.select("*", "_s.side", "_s.team", "_s.other", "_s.won").drop("_s", "a", "b", "y")


def co_occurrence(matches: DataFrame) -> DataFrame:
    """Every pair seen in a team: i, j, n."""
    pairs = sides(matches).select(F.explode(same_team("team")).alias("p"))
    return pairs.groupBy("p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))


def pair_domain(spark, n: int) -> DataFrame:
    """All n (n - 1) / 2 pairs, for statistics that count unseen ones as zero."""
    ids = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return ids.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n))).alias("j")).where(F.col("j") < n).withColumn("pair", pair_index("i", "j", n))


def residual_means(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
