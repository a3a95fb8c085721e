"""Reports on collected data: duplication, coverage, pools, budgets, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import n_rows


def count_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(n_rows().alias("n"))


def duplication(seen: DataFrame, key: str = "team_size") -> DataFrame:
    """seen: one row per match with seen_count."""
    return seen.groupBy(key).agg(n_rows().alias("n"), F.sum("seen_count").alias("seen"), F.round(F.sum("seen_count") / n_rows(), 2).alias("factor"))


def thin_cells(df: DataFrame, keys: list[str], below: int, top: int = 15) -> DataFrame:
    return df.groupBy(*keys).agg(n_rows().alias("n")).where(F.col("n") < below).orderBy("n", *keys).limit(top)


def total(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def alerts(metrics: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """metrics: one row; rules: message and condition.  One row per rule that fires."""
    fired = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in rules]), lambda x: x.isNotNull())
    return metrics.select(F.explode(fired).alias("alert"))


def due(pool: DataFrame, now: int, k: int) -> DataFrame:
    ready = pool.where((F.col("is_active") == 1) & (F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)))
    return ready.orderBy(F.desc("priority_score"), F.asc_nulls_first("next_poll_at"), "tag").limit(k)


def to_enrich(pool: DataFrame, now: int, age: int, k: int) -> DataFrame:
    stale = pool.where(F.col("enriched_at").isNull() | (F.col("enriched_at") < now - age))
    return stale.orderBy(F.col("enriched_at").isNull().desc(), F.desc("priority_score"), "tag").limit(k)


def checks(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Audit rows (name, value, ok) of aggregates: each test is a name and a struct column of value and ok, all in one pass."""
    one = df.agg(*[c.alias(f"_{i}") for i, (_, c) in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}.value").cast("double").alias("value"), F.col(f"_{i}.ok").alias("ok")) for i, (name, _) in enumerate(tests)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def verdict(ok) -> Column:
    ok = F.col(ok) if isinstance(ok, str) else ok
    return F.when(ok.isNull(), "INCONCLUSIVE").when(ok, "SUPPORTED").otherwise("CONTRADICTED")
