"""Collection health: volumes, duplication, pools, budgets, queues and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trifold.functions.expr import n_rows, tier
from trifold.operators import corpus, health, lookup, ranking
from trifold.plans.registry import query
from trifold.plans.views import L, M, P, PATCH, POOL
from trifold.session import durable
from trifold.sources import bind

#: The newest event's time is the report's now.
DAY = 86_400


def _now(log):
    return log.agg(F.max("epoch")).first()[0] or 0


@query(f"WITH {M} SELECT mode, map_id, count(*) AS n FROM m WHERE battle_type IN ('soloRanked', 'teamRanked') AND winning_team_idx IS NOT NULL GROUP BY ALL")
def coverage_map_mode(spark, sf):
    m = bind.matches(spark, sf).where((bind.is_ranked() == 1) & F.col("winning_team_idx").isNotNull())
    return health.count_by(m, "mode", "map_id")


@query(f"WITH {M} SELECT mode, map_id, count(*) AS n FROM m WHERE team_size = 3 GROUP BY ALL ORDER BY n DESC, mode, map_id LIMIT 25")
def coverage_top(spark, sf):
    m = bind.matches(spark, sf).where("team_size = 3")
    return health.count_by(m, "mode", "map_id").orderBy(F.desc("n"), "mode", "map_id").limit(25)


@query(
    f"""WITH {M}, {P}, g AS (SELECT match_id, count(*) AS n, count(*) FILTER (WHERE team_idx = 0) AS n0, count(DISTINCT brawler_id) FILTER (WHERE team_idx = 0) AS d0,
 count(DISTINCT brawler_id) FILTER (WHERE team_idx = 1) AS d1, max(brawler_id) AS top FROM p GROUP BY match_id)
SELECT CASE WHEN n IS NULL THEN 'noPlayers' WHEN n <> 6 THEN 'wrongCount' WHEN n0 <> 3 THEN 'badTeams' WHEN top >= 105 THEN 'unknownBrawler' WHEN d0 <> 3 OR d1 <> 3 THEN 'dupBrawler' ELSE 'ok' END AS drop_reason, count(*) AS n
FROM m LEFT JOIN g USING (match_id) GROUP BY 1"""
)
def draft_drop_reasons(spark, sf):
    return corpus.drop_counts(corpus.assemble(bind.matches(spark, sf), bind.players(spark, sf), known_ids=105))


SEEN = f"{M}, {P}, obs AS (SELECT match_id, count(*) AS seen_count FROM p GROUP BY match_id)"


@query(f"WITH {SEEN} SELECT team_size, count(*) AS n, CAST(sum(seen_count) AS BIGINT) AS seen, round(sum(seen_count) / count(*), 2) AS factor FROM m JOIN obs USING (match_id) GROUP BY team_size")
def duplication_factor(spark, sf):
    seen = bind.players(spark, sf).groupBy("match_id").agg(n_rows().alias("seen_count"))
    return health.duplication(bind.matches(spark, sf).select("match_id", "team_size").join(seen, "match_id"))


@query(f"WITH {SEEN} SELECT round(avg(seen_count), 6) AS mean_seen, max(seen_count) AS max_seen, CAST(sum(seen_count) AS BIGINT) AS records, round(sum(seen_count) / count(*), 6) AS ratio FROM obs")
def duplication_audit(spark, sf):
    seen = bind.players(spark, sf).groupBy("match_id").agg(n_rows().alias("seen_count"))
    s = F.sum("seen_count")
    return seen.agg(F.round(F.avg("seen_count"), 6).alias("mean_seen"), F.max("seen_count").alias("max_seen"), s.alias("records"), F.round(s / n_rows(), 6).alias("ratio"))


@query(f"WITH {M} SELECT mode, map_id, count(*) AS n FROM m GROUP BY ALL HAVING count(*) < 500 ORDER BY n, mode, map_id LIMIT 15")
def thin_cells(spark, sf):
    return health.thin_cells(bind.matches(spark, sf), ["mode", "map_id"], 500)


@query(f"WITH {POOL} SELECT CAST(sum(is_active) AS BIGINT) AS active, CAST(sum(1 - is_active) AS BIGINT) AS parked, count(*) AS total, count(enriched_at) AS enriched FROM pool")
def pool_health(spark, sf):
    a = F.col("is_active")
    return bind.pool(spark, sf).agg(F.sum(a).alias("active"), F.sum(1 - a).alias("parked"), n_rows().alias("total"), F.count("enriched_at").alias("enriched"))


TIER = "CASE WHEN ranked_rank >= 22 THEN 'pro' WHEN ranked_rank >= 19 THEN 'masters' WHEN ranked_rank >= 16 THEN 'legendary' WHEN ranked_rank >= 13 THEN 'mythic' WHEN ranked_rank >= 10 THEN 'diamond' WHEN ranked_rank >= 7 THEN 'gold' WHEN ranked_rank >= 4 THEN 'silver' WHEN ranked_rank >= 1 THEN 'bronze' END"


@query(f"WITH {POOL} SELECT {TIER} AS tier, count(*) AS n, min(ranked_rank) AS first_rank FROM pool WHERE ranked_rank IS NOT NULL GROUP BY 1 ORDER BY first_rank DESC LIMIT 20")
def tier_distribution(spark, sf):
    rows = bind.pool(spark, sf).where("ranked_rank IS NOT NULL").groupBy(tier("ranked_rank").alias("tier"))
    return rows.agg(n_rows().alias("n"), F.min("ranked_rank").alias("first_rank")).orderBy(F.desc("first_rank")).limit(20)


@query(f"WITH {POOL} SELECT region, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share, round(avg(CASE WHEN ranked_rank >= 10 THEN 1.0 ELSE 0 END), 6) AS diamond_share FROM pool GROUP BY region")
def rank_share(spark, sf):
    pool = bind.pool(spark, sf)
    total = pool.agg(n_rows().alias("total"))
    by = pool.groupBy("region").agg(n_rows().alias("n"), F.round(F.avg(F.when(F.col("ranked_rank") >= 10, 1.0).otherwise(0.0)), 6).alias("diamond_share"))
    return by.crossJoin(F.broadcast(total)).select("region", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "diamond_share")


@query(f"WITH {L} SELECT endpoint, count(*) AS n FROM l WHERE epoch > (SELECT max(epoch) FROM l) - 86400 GROUP BY endpoint")
def budget_split(spark, sf):
    log = bind.poll_log(spark, sf)
    return health.count_by(log.where(F.col("epoch") > _now(log) - DAY), "endpoint")


@query(f"WITH {L} SELECT count(*) AS polls, CAST(sum(new_matches) AS BIGINT) AS new_matches, CAST(coalesce(sum(CASE WHEN new_matches >= 22 THEN 1 ELSE 0 END), 0) AS BIGINT) AS suspected_loss, round(sum(new_matches) / CAST(count(*) AS DOUBLE), 6) AS per_poll FROM l WHERE epoch > (SELECT max(epoch) FROM l) - 86400")
def window24h_throughput(spark, sf):
    log = bind.poll_log(spark, sf)
    day = log.where(F.col("epoch") > _now(log) - DAY)
    new = F.sum("new_matches")
    return day.agg(n_rows().alias("polls"), new.alias("new_matches"), health.total(F.col("new_matches") >= 22).alias("suspected_loss"), F.round(new / n_rows(), 6).alias("per_poll"))


LAG = f"{M}, lag_ AS (SELECT mode, CAST(epoch(l_shipdate) AS BIGINT) - ts AS lag_s FROM lineitem JOIN m ON l_orderkey = match_id)"


@query(f"WITH {LAG} SELECT mode, round(avg(lag_s) / 60, 4) AS mean_lag_min, round(median(lag_s) / 60, 4) AS median_lag_min, count(*) AS n FROM lag_ GROUP BY mode")
def freshness_lag(spark, sf):
    seen = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("seen_at"))
    rows = seen.join(bind.matches(spark, sf).select("match_id", "ts", "mode"), "match_id").withColumn("lag", F.col("seen_at") - F.col("ts"))
    # Mean, number and median all come from the counts of each lag, so the join runs once.
    counts = durable(rows.groupBy("mode", "lag").agg(n_rows().alias("k")))
    mean = counts.groupBy("mode").agg(F.round(F.sum(F.col("lag") * F.col("k")) / F.sum(F.when(F.col("lag").isNotNull(), F.col("k"))) / 60, 4).alias("mean_lag_min"), F.sum("k").alias("n"))
    middle = ranking.median(counts, "lag", ["mode"], count="k").select(F.col("mode").alias("of"), F.round(F.col("median") / 60, 4).alias("median_lag_min"))
    return mean.join(middle, F.col("mode").eqNullSafe(F.col("of")), "left").select("mode", "mean_lag_min", "median_lag_min", "n")


@query(
    f"""WITH {L}, h AS (SELECT CAST(extract(hour FROM ts) AS INT) AS hour, count(*) AS polls, count(DISTINCT tag) AS players, CAST(sum(new_matches) AS BIGINT) AS new_matches, count(*) FILTER (WHERE status = 500) AS errors FROM l GROUP BY ALL)
SELECT hour, polls, players, new_matches, errors, round(polls / CAST(sum(polls) OVER () AS DOUBLE), 6) AS share FROM h"""
)
def hour_profile(spark, sf):
    """Who is online by hour of day: polls, players, new matches, errors and the hour's share of the polls."""
    log = bind.poll_log(spark, sf).groupBy(F.hour("ts").alias("hour"))
    h = log.agg(n_rows().alias("polls"), F.count_distinct("tag").alias("players"), F.sum("new_matches").alias("new_matches"), health.total(F.col("status") == 500).alias("errors"))
    total = h.agg(F.sum("polls").alias("total"))  # of 24 hours
    return h.crossJoin(F.broadcast(total)).select("hour", "polls", "players", "new_matches", "errors", F.round(F.col("polls") / F.col("total"), 6).alias("share"))


@query(f"WITH {M}, {P}, g AS (SELECT match_id, count(*) AS n FROM p GROUP BY match_id) SELECT coalesce(CAST(n AS VARCHAR), 'none') || ' players' AS reason, mode, count(*) AS n FROM m LEFT JOIN g USING (match_id) WHERE n IS NULL OR n <> 6 GROUP BY ALL")
def reject_reasons(spark, sf):
    g = bind.players(spark, sf).groupBy("match_id").agg(n_rows().alias("k"))
    rows = bind.matches(spark, sf).join(g, "match_id", "left").where("k IS NULL OR k <> 6")
    return health.count_by(rows.withColumn("reason", F.concat(F.coalesce(F.col("k").cast("string"), F.lit("none")), F.lit(" players"))), "reason", "mode")


@query(f"WITH {L} SELECT status, endpoint, count(*) AS n FROM l WHERE status NOT IN (200, 404) GROUP BY ALL")
def http_errors(spark, sf):
    return health.count_by(bind.poll_log(spark, sf).where(~F.col("status").isin(200, 404)), "status", "endpoint")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_inventory(spark, sf):
    out = None
    for t in TABLES:
        one = bind.table(spark, sf, t).agg(n_rows().alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {M} SELECT battle_type, CASE WHEN battle_type IN ('soloRanked', 'teamRanked') THEN 1 ELSE 0 END AS is_ranked, team_size, count(*) AS n FROM m GROUP BY ALL")
def by_type_size(spark, sf):
    return health.count_by(bind.matches(spark, sf).withColumn("is_ranked", bind.is_ranked()), "battle_type", "is_ranked", "team_size")


@query(f"WITH {M}, {PATCH} SELECT coalesce(patch_id, '(none)') AS patch_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM m LEFT JOIN patch ON start <= t AND (stop IS NULL OR stop > t) GROUP BY 1")
def patch_segments(spark, sf):
    m = lookup.interval(bind.matches(spark, sf), bind.patches(spark), "t", ["patch_id"])
    return m.groupBy(F.coalesce("patch_id", F.lit("(none)")).alias("patch_id")).agg(n_rows().alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(
    f"""WITH {M}, {P}, {POOL} SELECT m.mode, count(DISTINCT m.match_id) AS n_matches, count(DISTINCT p.player) AS n_players, count(DISTINCT CASE WHEN pool.ranked_rank >= 10 THEN p.player END) AS n_high,
 count(DISTINCT CASE WHEN pool.tag IS NULL THEN p.player END) AS n_unknown FROM m JOIN p USING (match_id) LEFT JOIN pool ON pool.tag = p.player GROUP BY m.mode"""
)
def rank_touch_distinct(spark, sf):
    rows = bind.matches(spark, sf).select("match_id", "mode").join(bind.players(spark, sf).select("match_id", "player"), "match_id")
    # Distinct (mode, player) first: the pool joins far fewer rows.
    pool = bind.pool(spark, sf).select(F.col("tag").alias("player"), "ranked_rank", F.lit(True).alias("known"))
    who = rows.select("mode", "player").distinct().join(pool, "player", "left")
    high, unknown = F.col("ranked_rank") >= 10, F.col("known").isNull()
    count = lambda c: F.count(F.when(c, F.lit(1)))
    by = who.groupBy("mode").agg(n_rows().alias("n_players"), count(high).alias("n_high"), count(unknown).alias("n_unknown"))
    return rows.groupBy("mode").agg(F.count_distinct("match_id").alias("n_matches")).join(by, "mode")


@query(f"WITH {POOL} SELECT tag, priority_score, next_poll_at FROM pool WHERE is_active = 1 AND (next_poll_at IS NULL OR next_poll_at <= 1005000) ORDER BY priority_score DESC, next_poll_at ASC NULLS FIRST, tag LIMIT 50")
def due_queue(spark, sf):
    return health.due(bind.pool(spark, sf), 1_005_000, 50).select("tag", "priority_score", "next_poll_at")


@query(f"WITH {POOL} SELECT tag, priority_score, enriched_at FROM pool WHERE enriched_at IS NULL OR enriched_at < 1000000 - 50000 ORDER BY enriched_at IS NULL DESC, priority_score DESC, tag LIMIT 50")
def enrich_queue(spark, sf):
    return health.to_enrich(bind.pool(spark, sf), 1_000_000, 50_000, 50).select("tag", "priority_score", "enriched_at")


@query(
    f"""WITH {L}, x AS (SELECT count(*) AS polls, sum(CASE WHEN new_matches >= 22 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS loss, sum(CASE WHEN status = 500 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS errors,
 sum(CASE WHEN new_matches = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS empty FROM l)
SELECT 'suspected loss above 5 %' AS alert FROM x WHERE loss > 0.05 UNION ALL SELECT 'errors above 2 %' FROM x WHERE errors > 0.02
 UNION ALL SELECT 'half of the polls are empty' FROM x WHERE empty > 0.5 UNION ALL SELECT 'no polls' FROM x WHERE polls = 0"""
)
def alerts(spark, sf):
    share = lambda c: health.total(c) / F.greatest(n_rows(), F.lit(1))
    x = bind.poll_log(spark, sf).agg(n_rows().alias("polls"), share(F.col("new_matches") >= 22).alias("loss"), share(F.col("status") == 500).alias("errors"), share(F.col("new_matches") == 0).alias("empty"))
    rules = [("suspected loss above 5 %", F.col("loss") > 0.05), ("errors above 2 %", F.col("errors") > 0.02), ("half of the polls are empty", F.col("empty") > 0.5), ("no polls", F.col("polls") == 0)]
    return health.alerts(x, rules)


@query(
    f"""WITH {M}, x AS (SELECT count(*) AS n, count(DISTINCT match_id) AS ids, count(*) FILTER (WHERE winning_team_idx IS NULL) AS undecided, avg(CASE WHEN winning_team_idx = 0 THEN 1.0 WHEN winning_team_idx = 1 THEN 0 END) AS side FROM m)
SELECT 'unique match_id' AS name, CAST(n - ids AS DOUBLE) AS value, n = ids AS ok FROM x UNION ALL SELECT 'undecided share', round(undecided / CAST(n AS DOUBLE), 6), undecided < n / 2 FROM x UNION ALL SELECT 'side balance', round(side, 6), abs(side - 0.5) < 0.05 FROM x"""
)
def data_audit(spark, sf):
    won = F.avg(1.0 - F.col("winning_team_idx"))
    none = F.count(F.when(F.col("winning_team_idx").isNull(), 1))
    row = lambda v, ok: F.struct(v.alias("value"), ok.alias("ok"))
    ids = F.count_distinct("match_id")
    tests = [("unique match_id", row(n_rows() - ids, n_rows() == ids)), ("undecided share", row(F.round(none / n_rows(), 6), none < n_rows() / 2)), ("side balance", row(F.round(won, 6), F.abs(won - 0.5) < 0.05))]
    return health.checks(bind.matches(spark, sf), tests)


@query(f"WITH {L} SELECT tag, count(*) AS polls, round(sum(new_matches) / CAST(count(*) AS DOUBLE), 6) AS per_poll, round(sum(new_matches) / greatest((max(epoch) - min(epoch)) / 3600.0, 0.25), 4) AS per_hour FROM l GROUP BY tag")
def yield_per_key(spark, sf):
    new = F.sum("new_matches")
    hours = F.greatest((F.max("epoch") - F.min("epoch")) / 3600, F.lit(0.25))
    return bind.poll_log(spark, sf).groupBy("tag").agg(n_rows().alias("polls"), F.round(new / n_rows(), 6).alias("per_poll"), F.round(new / hours, 4).alias("per_hour"))


@query(f"WITH {L}, b AS (SELECT new_matches // 5 AS step, count(*) AS n, avg(CASE WHEN status = 200 THEN 1.0 ELSE 0 END) AS clean, sum(latency) / count(*) AS lat FROM l GROUP BY 1) SELECT step, n, round(clean, 6) AS clean, round(lat, 4) AS latency, n = max(n) OVER () AS busiest FROM b")
def step_metrics(spark, sf):
    by = bind.poll_log(spark, sf).groupBy(F.expr("new_matches div 5").alias("step")).agg(n_rows().alias("n"), F.avg((F.col("status") == 200).cast("int")).alias("clean"), (F.sum("latency") / n_rows()).alias("latency"))
    top = by.agg(F.max("n").alias("most"))
    return by.crossJoin(F.broadcast(top)).select("step", "n", F.round("clean", 6).alias("clean"), F.round("latency", 4).alias("latency"), (F.col("n") == F.col("most")).alias("busiest"))
