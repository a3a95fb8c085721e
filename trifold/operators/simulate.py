"""Matches with planted effects, made column by column from counter-based draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.functions.expr import sigmoid, uniform


def normal(seed: int, k) -> Column:
    """A normal draw from two uniform ones."""
    u = F.greatest(uniform(seed, k * 2), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, k * 2 + 1))


def truth(spark: SparkSession, n: int, spread: float, seed: int = 7) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("brawler_id"), (spread * normal(seed, F.col("id"))).alias("w"))


def drafts(spark: SparkSession, n_matches: int, n: int = 107, spread: float = 0.4, seed: int = 20260805) -> DataFrame:
    """match_id, a, b, y with wins drawn from the difference of planted strengths."""
    from trifold.operators.decide import score

    m = spark.range(n_matches).withColumnRenamed("id", "match_id")
    # Draws first, as columns of their own; then six picks without repeats within a team.
    m = m.withColumns({f"_u{j}": uniform(seed, F.col("match_id") * 8 + j) for j in range(7)})
    for name, j in (("a", 0), ("b", 3)):
        m = m.withColumn("_x", F.floor(F.col(f"_u{j}") * n).cast("int")).withColumn("_y", F.floor(F.col(f"_u{j + 1}") * (n - 1)).cast("int"))
        m = m.withColumn("_y", F.when(F.col("_y") >= F.col("_x"), F.col("_y") + 1).otherwise(F.col("_y"))).withColumn("_z", F.floor(F.col(f"_u{j + 2}") * (n - 2)).cast("int"))
        for taken in (F.least("_x", "_y"), F.greatest("_x", "_y")):  # skip what is taken, the lower first
            m = m.withColumn("_z", F.when(F.col("_z") >= taken, F.col("_z") + 1).otherwise(F.col("_z")))
        m = m.withColumn(name, F.array("_x", "_y", "_z")).drop("_x", "_y", "_z")
    s = score(m, truth(spark, n, spread))
    return s.withColumn("y", (F.col("_u6") < sigmoid("z")).cast("int")).withColumn("mode", F.lit("m")).withColumn("map_id", F.lit(0)).withColumnRenamed("z", "true_z").drop("p", *[f"_u{j}" for j in range(7)])
