"""Ranks, shares, correlations and quality of probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from trifold.functions.expr import n_rows, decay, norm_cdf, p_of_interval
from trifold.operators import metrics, ranking
from trifold.plans.registry import query
from trifold.plans.views import D, L, M, PATCH, SC
from trifold.sources import bind

_T2 = "(1 / (1 + 0.2316419 * abs(z)))"
CDF = f"(CASE WHEN z >= 0 THEN 1 - exp(-z * z / 2) / sqrt(2 * pi()) * ((((1.330274429 * {_T2} - 1.821255978) * {_T2} + 1.781477937) * {_T2} - 0.356563782) * {_T2} + 0.319381530) * {_T2} ELSE exp(-z * z / 2) / sqrt(2 * pi()) * ((((1.330274429 * {_T2} - 1.821255978) * {_T2} + 1.781477937) * {_T2} - 0.356563782) * {_T2} + 0.319381530) * {_T2} END)"


@query(
    f"""WITH {SC}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM sc)
SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM r"""
)
def auc_tied(spark, sf):
    return metrics.auc(bind.scored(spark, sf)).withColumn("auc", F.round("auc", 6))


@query(f"WITH {SC} SELECT round(avg(-(y * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM sc")
def logloss_brier(spark, sf):
    return metrics.losses(bind.scored(spark, sf)).select(F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"), "n")


BINS = f"{SC}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS n FROM sc), b AS (SELECT CAST(floor((rn * 10 - 1) / n) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS share FROM r GROUP BY 1)"


@query(f"WITH {BINS} SELECT bin, n, round(mean_p, 6) AS mean_p, round(share, 6) AS share FROM b")
def calibration_bins(spark, sf):
    return metrics.calibration(bind.scored(spark, sf), "id").select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("share", 6).alias("share"))


@query(f"WITH {BINS} SELECT round(sum(n * abs(mean_p - share)) / sum(n), 6) AS ece FROM b")
def calibration_error(spark, sf):
    return metrics.ece(metrics.calibration(bind.scored(spark, sf), "id")).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {M}, r AS (SELECT match_id, t, row_number() OVER (ORDER BY t, match_id) AS rn, count(*) OVER () AS n FROM m) SELECT CAST(floor((rn * 5 - 1) / n) AS INT) AS fold, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM r GROUP BY 1")
def forward_folds(spark, sf):
    m = bind.matches(spark, sf).select("match_id", "t")
    r = ranking.row_number(m, [F.col("t"), F.col("match_id")])
    return r.groupBy(ranking.forward_fold(F.col("rn"), m.count(), 5).alias("fold")).agg(n_rows().alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"WITH {M}, r AS (SELECT match_id, mode, row_number() OVER (ORDER BY t, match_id) AS rn, count(*) OVER () AS n FROM m) SELECT mode, count(*) AS n FROM r WHERE rn > floor(n * (1 - 0.25)) GROUP BY mode")
def recent_slice(spark, sf):
    m = bind.matches(spark, sf).select("match_id", "t", "mode")
    r = ranking.row_number(m, [F.col("t"), F.col("match_id")])
    return r.where(F.col("rn") > int(m.count() * 0.75)).groupBy("mode").agg(n_rows().alias("n"))


TESTS = f"{M}, g AS (SELECT map_id, mode, count(*) AS n, avg(1 - winning_team_idx) AS r FROM m WHERE winning_team_idx IS NOT NULL GROUP BY ALL), z AS (SELECT map_id, mode, n, (r - 0.5) / sqrt(0.25 / n) AS z0 FROM g), q AS (SELECT map_id, mode, n, abs(z0) AS z FROM z), pv AS (SELECT map_id, mode, n, round(2 * (1 - {CDF}), 9) AS p FROM q)"


@query(
    f"""WITH {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, map_id * 10 + CAST(mode[1] AS INT)) AS place, count(*) OVER () AS m FROM pv), c AS (SELECT coalesce(max(place), 0) AS cut FROM r WHERE p <= 0.05 * place / m)
SELECT map_id, mode, n, round(p, 6) AS p, place, place <= cut AS fdr, p < 0.05 / m AS bonferroni FROM r, c"""
)
def bh_fdr(spark, sf):
    m = bind.matches(spark, sf).where("winning_team_idx IS NOT NULL")
    g = m.groupBy("map_id", "mode").agg(n_rows().alias("n"), F.avg(1 - F.col("winning_team_idx")).alias("r"))
    p = F.round(2 * (1 - norm_cdf(F.abs((F.col("r") - 0.5) / F.sqrt(0.25 / F.col("n"))))), 9)
    key = F.col("map_id") * 10 + F.substring("mode", 1, 1).cast("int")
    tests = g.select("map_id", "mode", "n", p.alias("p"), key.alias("key"))
    return ranking.false_discovery(tests, "p", "key").select("map_id", "mode", "n", F.round("p", 6).alias("p"), "place", "fdr", "bonferroni")


@query(f"WITH {SC}, r AS (SELECT row_number() OVER (ORDER BY score, id) AS rx, row_number() OVER (ORDER BY id * 7919 % 1009, id) AS ry FROM sc) SELECT round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf):
    s = bind.scored(spark, sf).withColumn("other", F.col("id") * 7919 % 1009)
    return ranking.spearman(s, "score", "other", "id").select(F.round("rho", 6).alias("rho"), "n")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem")
def pearson_slope(spark, sf):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return bind.table(spark, sf, "lineitem").agg(F.round(F.corr(x, y), 6).alias("r"), F.round(F.sum(x * y) / F.sum(x * x), 4).alias("slope"))


PICKS = f"{D}, pk AS (SELECT unnest(list_concat(a, b)) AS brawler_id FROM d), h AS (SELECT brawler_id, count(*) AS n FROM pk GROUP BY brawler_id)"


def _picks(spark, sf):
    return bind.drafts(spark, sf).select(F.explode(F.concat("a", "b")).alias("brawler_id"))


@query(f"WITH {PICKS}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, brawler_id) AS rank, sum(n) OVER () AS total FROM h) SELECT round(-regr_slope(ln(n / total), ln(rank)), 6) AS zipf, count(*) AS n_keys FROM r")
def zipf_exponent(spark, sf):
    return ranking.zipf_exponent(_picks(spark, sf), "brawler_id").select(F.round("zipf", 6).alias("zipf"), "n_keys")


@query(f"WITH {PICKS}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, brawler_id) AS rank, sum(n) OVER () AS total FROM h) SELECT k, round(sum(n) / max(total), 6) AS share FROM r, (VALUES (5), (10), (20)) v(k) WHERE rank <= k GROUP BY k")
def topk_share(spark, sf):
    return ranking.top_share(_picks(spark, sf), "brawler_id", [5, 10, 20]).select("k", F.round("share", 6).alias("share"))


@query(f"WITH {PICKS} SELECT brawler_id, n, round(ln((n + 1) / (SELECT CAST(sum(n) AS DOUBLE) FROM h)), 6) AS log_rate FROM h")
def pick_rates(spark, sf):
    by = _picks(spark, sf).groupBy(F.col("brawler_id").cast("long").alias("brawler_id")).agg(n_rows().alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("brawler_id", "n", F.round(F.log((F.col("n") + 1) / F.col("total")), 6).alias("log_rate"))


@query(f"WITH {D}, x AS (SELECT match_id, unnest([1, 2, 3]) AS slot, unnest(a) AS brawler_id FROM d), g AS (SELECT slot, brawler_id, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n DESC, brawler_id) AS k, sum(n) OVER (PARTITION BY slot) AS total FROM g) SELECT slot, round(sum(n) FILTER (WHERE k <= 5) / max(total), 6) AS top5, count(*) AS n_distinct FROM r GROUP BY slot")
def slot_concentration(spark, sf):
    from pyspark.sql import Window

    x = bind.drafts(spark, sf).select(F.posexplode("a").alias("pos", "brawler_id"))
    g = x.groupBy((F.col("pos") + 1).alias("slot"), "brawler_id").agg(n_rows().alias("n"))  # characters by slots
    r = g.withColumn("k", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), "brawler_id")))
    return r.groupBy("slot").agg(F.round(F.sum(F.when(F.col("k") <= 5, F.col("n"))) / F.sum("n"), 6).alias("top5"), n_rows().alias("n_distinct"))


@query(f"WITH {L}, r AS (SELECT endpoint, latency, row_number() OVER (PARTITION BY endpoint ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM l) SELECT endpoint, CAST(p AS DOUBLE) AS p, latency FROM r, (VALUES (0.05), (0.5), (0.95)) v(p) WHERE i = floor(CAST(p AS DOUBLE) * (n - 1))")
def quantile_orderstat(spark, sf):
    return ranking.order_statistic(bind.poll_log(spark, sf), "latency", [0.05, 0.5, 0.95], ["endpoint"])


@query("WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT CAST(p AS DOUBLE) AS p, v FROM r, (VALUES (0.1), (0.5), (0.9)) q(p) WHERE i = floor(CAST(p AS DOUBLE) * (n - 1))")
def global_quantiles(spark, sf):
    rows = bind.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"))
    return ranking.order_statistic(rows, "v", [0.1, 0.5, 0.9])


@query(f"WITH {M}, x AS (SELECT mode, pow(0.5, date_diff('day', t, (SELECT max(t) FROM m)) / 365.0) AS w FROM m) SELECT mode, round(sum(w), 4) AS weight, count(*) AS n FROM x GROUP BY mode")
def time_decay(spark, sf):
    m = bind.matches(spark, sf).select("mode", "t")
    last = m.agg(F.max("t").alias("last"))
    w = decay(F.datediff(F.col("last"), F.col("t")), 365.0)
    return m.crossJoin(F.broadcast(last)).groupBy("mode").agg(F.round(F.sum(w), 4).alias("weight"), n_rows().alias("n"))


@query(f"WITH {M}, g AS (SELECT map_id, min(t) AS first_seen FROM m GROUP BY map_id) SELECT map_id, row_number() OVER (ORDER BY first_seen, map_id) - 1 AS id FROM g")
def dense_first_seen(spark, sf):
    return ranking.dense_first_seen(bind.matches(spark, sf), "map_id", "t").select("map_id", "id")


@query(f"WITH {M}, g AS (SELECT map_id, mode, count(*) AS n FROM m GROUP BY ALL) SELECT CASE WHEN n < 50 THEN 'thin' WHEN n < 100 THEN 'some' ELSE 'thick' END AS tier, count(*) AS cells, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
def volume_tiers(spark, sf):
    g = bind.matches(spark, sf).groupBy("map_id", "mode").agg(n_rows().alias("n"))
    name = F.when(F.col("n") < 50, "thin").when(F.col("n") < 100, "some").otherwise("thick")
    return g.groupBy(name.alias("tier")).agg(n_rows().alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n"))


@query(f"WITH {M}, g AS (SELECT mode, map_id, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT mode, n, row_number() OVER (PARTITION BY mode ORDER BY n DESC, map_id) AS k, count(*) OVER (PARTITION BY mode) AS c FROM g) SELECT mode, max(n) FILTER (WHERE k = floor(0.5 * c) + 1) AS q50, max(n) FILTER (WHERE k = floor(0.9 * c) + 1) AS q90 FROM r GROUP BY mode")
def map_volumes(spark, sf):
    from pyspark.sql import Window

    g = bind.matches(spark, sf).groupBy("mode", "map_id").agg(n_rows().alias("n"))
    w = Window.partitionBy("mode")
    r = g.withColumns({"k": F.row_number().over(w.orderBy(F.desc("n"), "map_id")), "c": F.count(F.lit(1)).over(w)})
    at = lambda p: F.max(F.when(F.col("k") == F.floor(p * F.col("c")) + 1, F.col("n")))
    return r.groupBy("mode").agg(at(F.lit(0.5)).alias("q50"), at(F.lit(0.9)).alias("q90"))


@query(
    f"""WITH {M}, {PATCH}, g AS (SELECT patch_id, mode, map_id, count(*) AS n FROM m JOIN patch ON start <= t AND (stop IS NULL OR stop > t) GROUP BY ALL),
r AS (SELECT patch_id, mode, n, row_number() OVER (PARTITION BY patch_id, mode ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY patch_id, mode) AS c FROM g)
SELECT patch_id, mode, max(n) FILTER (WHERE k = floor(CAST(0.5 AS DOUBLE) * (c - 1))) AS q50, max(n) FILTER (WHERE k = floor(CAST(0.9 AS DOUBLE) * (c - 1))) AS q90 FROM r GROUP BY patch_id, mode"""
)
def map_volumes_patch(spark, sf):
    """Order statistics of the maps' volumes in each patch and mode."""
    from trifold.operators import lookup

    m = lookup.interval(bind.matches(spark, sf), bind.patches(spark), "t", ["patch_id"]).where("patch_id IS NOT NULL")
    g = m.groupBy("patch_id", "mode", "map_id").agg(n_rows().alias("n"))
    rows = ranking.order_statistic(g, "n", [0.5, 0.9], ["patch_id", "mode"])
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("n")))
    return rows.groupBy("patch_id", "mode").agg(at(0.5).alias("q50"), at(0.9).alias("q90"))


@query(f"WITH {M}, r AS (SELECT match_id, row_number() OVER (ORDER BY t, match_id) AS rn FROM m) SELECT match_id, rn FROM r WHERE (rn - 1) % 97 = 0")
def stride_sample(spark, sf):
    r = ranking.row_number(bind.matches(spark, sf).select("match_id", "t"), [F.col("t"), F.col("match_id")])
    return r.where((F.col("rn") - 1) % 97 == 0).select("match_id", "rn")


@query(f"WITH {M}, {PATCH}, g AS (SELECT patch_id, mode, count(*) AS n FROM m JOIN patch ON start <= t AND (stop IS NULL OR stop > t) GROUP BY ALL), q AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY patch_id) AS DOUBLE) AS s FROM g), a AS (SELECT mode, avg(s) AS s0 FROM q GROUP BY mode) SELECT patch_id, round(sum(0.5 * s * ln(s / ((s + s0) / 2)) + 0.5 * s0 * ln(s0 / ((s + s0) / 2))), 6) AS divergence FROM q JOIN a USING (mode) GROUP BY patch_id")
def drift_divergence(spark, sf):
    from pyspark.sql import Window

    from trifold.operators import lookup

    m = lookup.interval(bind.matches(spark, sf), bind.patches(spark), "t", ["patch_id"]).where("patch_id IS NOT NULL")
    g = m.groupBy("patch_id", "mode").agg(n_rows().alias("n"))
    q = g.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("patch_id")))
    q = q.join(q.groupBy("mode").agg(F.avg("s").alias("s0")), "mode")
    mid = (F.col("s") + F.col("s0")) / 2
    term = 0.5 * F.col("s") * F.log(F.col("s") / mid) + 0.5 * F.col("s0") * F.log(F.col("s0") / mid)
    return q.groupBy("patch_id").agg(F.round(F.sum(term), 6).alias("divergence"))


@query(
    f"""WITH {D}, g AS (SELECT map_id, count(*) AS n, avg(y - 0.5) AS delta, 1.96 * stddev_samp(y) / sqrt(count(*)) AS h FROM d WHERE y IS NOT NULL GROUP BY map_id),
z AS (SELECT *, CASE WHEN h > 0 THEN abs(delta) / (2 * h / 3.92) ELSE 0 END AS z FROM g), t AS (SELECT *, 1 / (1 + 0.3275911 * z / sqrt(2)) AS t FROM z)
SELECT map_id, n, round(delta - h, 5) AS low, round(delta + h, 5) AS high, round(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2), 5) AS p FROM t"""
)
def interval_pvalue(spark, sf):
    """A p-value from an interval's ends alone, here of each map's advantage of team 0."""
    half = 1.96 * F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))
    g = bind.decided(spark, sf).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - 0.5).alias("delta"), half.alias("h"))
    low, high = F.col("delta") - F.col("h"), F.col("delta") + F.col("h")
    return g.select("map_id", "n", F.round(low, 5).alias("low"), F.round(high, 5).alias("high"), F.round(p_of_interval("delta", low, high), 5).alias("p"))
