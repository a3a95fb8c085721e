"""The poll loop's bookkeeping: counts by tag merged batch by batch, and players looked up every few batches.

A batch writes what it adds, and nothing else, into a folder of its own number,
so an ordinary batch reads no state and a batch that runs twice replaces itself.
Every ``every`` batches the additions so far are summed into a snapshot, and the
players whom nobody has looked up yet are asked for, the most active first.  A
batch reads only folders of smaller numbers, so a repeated one sees what it saw."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.operators.health import to_enrich
from trifold.session import children, remove

#: What a batch adds; the tag keeps its own type.
ADDED = ["polls", "new_matches", "last_poll", "ranked_rank", "enriched_at"]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(x.split("=")[1]) for x in children(spark, folder) if x.startswith("batch="))


def merged(additions: DataFrame) -> DataFrame:
    """One row a tag: polls and new matches in all, the last poll, and the rank as last looked up."""
    at = F.col("enriched_at")
    return additions.groupBy("tag").agg(
        F.sum("polls").alias("polls"), F.sum("new_matches").alias("new_matches"), F.max("last_poll").alias("last_poll"),
        F.max_by("ranked_rank", F.when(at.isNotNull(), at)).alias("ranked_rank"), F.max("enriched_at").alias("enriched_at"),
    )


def before(spark: SparkSession, base: str, k: int | None = None) -> DataFrame | None:
    """The table as it stood before batch ``k`` (None: after all): the last snapshot and the additions since; None if there is nothing."""
    upto = lambda folder: [n for n in _numbers(spark, folder) if k is None or n < k]
    snapshots, added = upto(f"{base}/snapshot"), upto(f"{base}/added")
    last = snapshots[-1] if snapshots else -1
    paths = [f"{base}/snapshot/batch={last}"] * bool(snapshots) + [f"{base}/added/batch={n}" for n in added if n > last]
    return merged(spark.read.parquet(*paths)) if paths else None


def added(polls: DataFrame) -> DataFrame:
    """What a batch's polls (tag, epoch, new_matches) add; null tags are left out, null counts are polls without matches."""
    by = polls.where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("polls"), F.sum(F.coalesce("new_matches", F.lit(0)).cast("long")).alias("new_matches"), F.max("epoch").cast("long").alias("last_poll"))
    return by.withColumns({"ranked_rank": F.lit(None).cast("int"), "enriched_at": F.lit(None).cast("long")})


def put(base: str, every: int, limit: int, age: int, fetch: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds a batch and, every ``every`` batches, looks up ``limit`` players.

    fetch takes their tags and returns tag, ranked_rank of those it found; others are
    asked for again next time.  A player is looked up anew ``age`` seconds after the
    last time.  Time is that of the latest poll known, so a repeated batch asks as before."""

    def run(batch: DataFrame, k: int) -> None:
        spark, mine = batch.sparkSession, f"{base}/added/batch={k}"
        added(batch).write.mode("overwrite").parquet(mine)
        if (k + 1) % every:
            return
        old, new = before(spark, base, k), spark.read.parquet(mine)
        table = merged(new) if old is None else merged(old.unionByName(new))
        now = table.agg(F.max("last_poll")).first()[0]
        if now is None:
            return
        queue = to_enrich(table.withColumn("priority_score", F.col("new_matches")), now, age, limit).select("tag")
        found = fetch(queue).select("tag", F.lit(0).cast("long").alias("polls"), F.lit(0).cast("long").alias("new_matches"), F.lit(None).cast("long").alias("last_poll"), F.col("ranked_rank").cast("int").alias("ranked_rank"), F.lit(now).cast("long").alias("enriched_at"))
        # The snapshot holds this batch's own additions too, so those are read no more.
        merged(table.unionByName(found)).write.mode("overwrite").parquet(f"{base}/snapshot/batch={k}")

    return run


def tidy(spark: SparkSession, base: str, k: int) -> None:
    """Removes what lies before the last snapshot below batch ``k``, once batch ``k`` is committed and so can't run again."""
    done = [n for n in _numbers(spark, f"{base}/snapshot") if n < k]
    if not done:
        return
    for n in _numbers(spark, f"{base}/added"):
        if n <= done[-1]:
            remove(spark, f"{base}/added/batch={n}")
    for n in done[:-1]:
        remove(spark, f"{base}/snapshot/batch={n}")


def run(polls: DataFrame, base: str, fetch: Callable[[DataFrame], DataFrame], every: int = 5, limit: int = 50, age: int = 7 * 86_400) -> DataFrame:
    """Runs the stream of polls over what is there and returns the table; with the folder of a run before it goes on from there."""
    spark = polls.sparkSession
    q = polls.writeStream.option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).foreachBatch(put(base, every, limit, age, fetch)).start()
    q.awaitTermination()
    return before(spark, base)
