"""The poll loop as a fold and as a stream, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.operators import lookup
from trifold.plans.registry import query
from trifold.plans.views import POOL, L
from trifold.session import shared_folder
from trifold.sources import bind
from trifold.streaming import controller, enrich

FOLD = f"""WITH RECURSIVE {L}, o AS (SELECT tag, epoch, new_matches AS n, row_number() OVER (PARTITION BY tag ORDER BY epoch, event_id) AS rn, count(*) OVER (PARTITION BY tag) AS polls FROM l WHERE new_matches IS NOT NULL),
f(tag, rn, i, e, losses, a, t) AS (SELECT DISTINCT tag, CAST(0 AS BIGINT), CAST(3600 AS BIGINT), 0, 0, CAST(0 AS DOUBLE), CAST(NULL AS BIGINT) FROM o UNION ALL
 SELECT f.tag, o.rn, CAST(floor(least(1209600, greatest(900, i * CASE WHEN n >= 22 THEN 0.5 WHEN n >= 15 THEN 0.8 WHEN n = 0 THEN 2 WHEN n <= 2 THEN 1.5 ELSE 1 END + 0.5))) AS BIGINT), CASE WHEN n = 0 THEN e + 1 ELSE 0 END, losses + CASE WHEN n >= 22 AND o.rn > 1 THEN 1 ELSE 0 END,
 CAST(0.7 AS DOUBLE) * a + CAST(0.3 AS DOUBLE) * (n / CASE WHEN t IS NULL THEN CAST(1 AS DOUBLE) ELSE greatest((o.epoch - t) / CAST(3600 AS DOUBLE), CAST(0.25 AS DOUBLE)) END * 24), o.epoch
 FROM f JOIN o ON o.tag = f.tag AND o.rn = f.rn + 1)
SELECT f.tag, CAST(polls AS INT) AS polls, i AS "interval", e AS empties, losses, e <= 6 AS active, round(a, 6) AS activity, t AS last_poll FROM f JOIN o ON o.tag = f.tag AND o.rn = f.rn WHERE f.rn = polls"""


@query(FOLD)
def controller_fold(spark, sf):
    return controller.fold(bind.poll_log(spark, sf)).withColumn("activity", F.round("activity", 6))


def _stream(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A pattern, since a stream's plain path has to be a folder and the table may be one file.
    # A trigger takes about 4 GB of files, one at least, which bounds a tag's rows in one batch.
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", 4 << 30).parquet(f"{sf}/events.parque[t]")


def run(df: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its batches' rows, with the batch they came in.

    Batches are written under their number, so a batch that runs twice replaces
    itself.  With the ``base`` folder of a run before, which may have been
    stopped anywhere, the stream goes on from its state and reads only what is new."""
    spark = df.sparkSession
    base = base or f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def put(batch, k):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    # Typed state and timers need this store; it is named when a stream starts.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(FOLD)
def stream_controller(spark, sf):
    e = _stream(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int") % 26
    polls = e.select(F.col("user_id").alias("tag"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), "event_id", k.alias("new_matches"))
    # Files may lie in any order, so none of their polls counts as too late.
    out = run(controller.stream(polls, "100 years"), "update").where("event = 'state'").drop("event", "due_at")
    return lookup.latest(out, ["tag"], ["batch"]).drop("batch").withColumn("activity", F.round("activity", 6))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    """Hourly counts with a watermark, as a stream."""
    e = _stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    by = e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = run(by.select(F.col("window.start").alias("s"), "event_type", "n", "total"), "update")
    last = lookup.latest(out, ["s", "event_type"], ["batch"])
    return last.select(F.col("s").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, CAST(user_id AS BIGINT) AS user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """The first observation in time of each key, in whatever order they arrive."""
    out = run(controller.first_seen(_stream(spark, sf), ["event_type", "user_id"], ["ts", "event_id"]), "update")
    return lookup.latest(out, ["event_type", "user_id"], ["batch"]).select("event_type", "user_id", "event_id", "ts")


@query(
    f"""WITH {L}, {POOL}, g AS (SELECT tag, count(*) AS polls, CAST(sum(coalesce(new_matches, 0)) AS BIGINT) AS new_matches, max(epoch) AS last_poll FROM l WHERE tag IS NOT NULL GROUP BY tag), q AS (SELECT tag, max(last_poll) OVER () AS now, row_number() OVER (ORDER BY new_matches DESC, tag) AS k FROM g)
SELECT g.tag, polls, new_matches, last_poll, ranked_rank, CASE WHEN pool.tag IS NOT NULL THEN now END AS enriched_at FROM g JOIN q ON q.tag = g.tag LEFT JOIN pool ON pool.tag = g.tag AND k <= 50"""
)
def stream_enrichment(spark, sf):
    """Polls merged by tag as they arrive; after each batch the 50 most active players whom nobody has looked up are.

    The SQL is of one batch, which the events of the supplied scales are."""
    e = _stream(spark, sf)
    polls = e.select(F.col("user_id").alias("tag"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("epoch"), (F.get_json_object("props", "$.k").cast("int") % 26).alias("new_matches"))
    players = bind.pool(spark, sf).select("tag", "ranked_rank")
    return enrich.run(polls, f"{shared_folder(spark)}/{uuid.uuid4().hex}", lambda queue: queue.join(players, "tag"), every=1)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf):
    e = bind.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    by = e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"))
    return by.select("user_id", "start", "n")


@query("WITH w AS (SELECT event_id, value, date_trunc('day', ts) - INTERVAL (k) DAY AS start FROM events, range(7) t(k)) SELECT start, count(*) AS n, round(avg(value), 4) AS mean FROM w GROUP BY start")
def sliding_windows(spark, sf):
    e = bind.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    by = e.groupBy(F.window("at", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return by.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "mean")
