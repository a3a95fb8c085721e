"""Scalar functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trifold.functions import expr, text
from trifold.functions.expr import n_rows
from trifold.plans.registry import query
from trifold.plans.views import D, L, M, P, POOL, SHORT, wilson
from trifold.sources import bind

KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"WITH {M}, {P}, g AS (SELECT match_id, string_agg(player_tag, ',' ORDER BY player_tag) AS tags FROM p GROUP BY match_id) SELECT match_id, sha1(strftime(t, '%Y%m%dT%H%M%S.000Z') || '|' || tags) AS match_key FROM m JOIN g USING (match_id)")
def match_identity_sha1(spark, sf):
    tags = bind.players(spark, sf).groupBy("match_id").agg(F.collect_list("player_tag").alias("tags"))  # one match's players
    time = F.date_format(F.col("t").cast("timestamp"), "yyyyMMdd'T'HHmmss.'000Z'")
    return bind.matches(spark, sf).select("match_id", "t").join(tags, "match_id").select("match_id", expr.match_key(time, "tags").alias("match_key"))


@query(
    f"""WITH {M}, x AS (SELECT match_id, CASE match_id % 4 WHEN 0 THEN 'victory' WHEN 1 THEN 'defeat' WHEN 2 THEN 'draw' END AS result, CAST(c % 17 AS INT) - 8 AS change, CAST(c % 2 AS INT) AS mine FROM m)
SELECT match_id, CASE WHEN result = 'victory' THEN mine WHEN result = 'defeat' THEN 1 - mine WHEN result IS NULL AND change > 0 THEN mine WHEN result IS NULL AND change < 0 THEN 1 - mine END AS winner FROM x"""
)
def winner_resolution(spark, sf):
    k = F.col("match_id") % 4
    x = bind.matches(spark, sf).withColumn("result", F.when(k == 0, "victory").when(k == 1, "defeat").when(k == 2, "draw"))
    x = x.withColumns({"change": (F.col("c") % 17).cast("int") - 8, "mine": (F.col("c") % 2).cast("int")})
    return x.select("match_id", expr.winner("result", "change", "mine").alias("winner"))


@query(f"WITH {M} SELECT match_id, CAST(epoch(t) AS BIGINT) AS epoch, strftime(t, '%Y-%m-%d') AS day FROM m")
def compact_ts(spark, sf):
    m = bind.matches(spark, sf).withColumn("raw", F.date_format(F.col("t").cast("timestamp"), "yyyyMMdd'T'HHmmss.'000Z'"))
    ts = expr.compact_timestamp("raw")
    return m.select("match_id", F.unix_timestamp(ts).alias("epoch"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


@query(f"WITH {D} SELECT match_id, least(a[1], a[2]) * (213 - least(a[1], a[2])) // 2 + greatest(a[1], a[2]) - least(a[1], a[2]) - 1 AS pair FROM d")
def pair_index(spark, sf):
    d = bind.drafts(spark, sf)
    return d.select("match_id", expr.pair_index(F.col("a")[0], F.col("a")[1]).alias("pair"))


@query(
    f"""WITH {P}, g AS (SELECT match_id, avg(CASE WHEN team_idx = 0 THEN power END) - avg(CASE WHEN team_idx = 1 THEN power END) AS dp, ln(1 + avg(CASE WHEN team_idx = 0 THEN trophies END)) - ln(1 + avg(CASE WHEN team_idx = 1 THEN trophies END)) AS dt FROM p GROUP BY match_id)
SELECT match_id, round(dp, 6) AS power_diff, round(dt, 6) AS trophy_diff FROM g WHERE dp IS NOT NULL"""
)
def controls_diff(spark, sf):
    mean = lambda c, k: F.avg(F.when(F.col("team_idx") == k, F.col(c)))
    g = bind.players(spark, sf).groupBy("match_id").agg((mean("power", 0) - mean("power", 1)).alias("p"), (F.log1p(mean("trophies", 0)) - F.log1p(mean("trophies", 1))).alias("t"))
    return g.where("p IS NOT NULL").select("match_id", F.round("p", 6).alias("power_diff"), F.round("t", 6).alias("trophy_diff"))


@query(f"WITH {D} SELECT array_to_string(list_sort(list_transform(a, lambda x: {SHORT}[x % 7 + 1])), '+') AS comp, count(*) AS n FROM d GROUP BY 1")
def comp_key(spark, sf):
    d = bind.drafts(spark, sf).select(text.composition_key(F.transform("a", bind.class_of)).alias("comp"))
    return d.groupBy("comp").agg(n_rows().alias("n"))


LOW, HIGH = wilson("k", "n")


@query(f"WITH {M}, g AS (SELECT map_id, count(*) AS n, sum(1 - winning_team_idx) AS k FROM m WHERE winning_team_idx IS NOT NULL GROUP BY map_id) SELECT map_id, n, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM g")
def wilson_ci(spark, sf):
    m = bind.matches(spark, sf).where("winning_team_idx IS NOT NULL")
    g = m.groupBy("map_id").agg(n_rows().alias("n"), F.sum(1 - F.col("winning_team_idx")).alias("k"))
    low, high = expr.wilson("k", "n")
    return g.select("map_id", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_T1, _T2 = "(1 / (1 + 0.3275911 * abs(x)))", "(1 / (1 + 0.2316419 * abs(x)))"


@query(
    f"""WITH x AS (SELECT doc_id, (n_chars % 700 - 350) / 100.0 AS x FROM documents)
SELECT doc_id, round(sign(x) * (1 - ((((1.061405429 * {_T1} - 1.453152027) * {_T1} + 1.421413741) * {_T1} - 0.284496736) * {_T1} + 0.254829592) * {_T1} * exp(-x * x)), 6) AS erf,
 round(CASE WHEN x >= 0 THEN 1 - exp(-x * x / 2) / sqrt(2 * pi()) * ((((1.330274429 * {_T2} - 1.821255978) * {_T2} + 1.781477937) * {_T2} - 0.356563782) * {_T2} + 0.319381530) * {_T2}
 ELSE exp(-x * x / 2) / sqrt(2 * pi()) * ((((1.330274429 * {_T2} - 1.821255978) * {_T2} + 1.781477937) * {_T2} - 0.356563782) * {_T2} + 0.319381530) * {_T2} END, 6) AS cdf FROM x"""
)
def norm_cdf_erf(spark, sf):
    x = bind.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 700 - 350) / 100).alias("x"))
    return x.select("doc_id", F.round(expr.erf("x"), 6).alias("erf"), F.round(expr.norm_cdf("x"), 6).alias("cdf"))


@query(f"WITH {POOL} SELECT tag, round(priority_score / 100 + 0.8 * (coalesce(ranked_rank, 0) / 25.0) + 0.5 * least(greatest((1005000 - coalesce(next_poll_at, 1000000)) / 3600.0, 0), 24) - 1.2 * (tag % 3) / 3.0, 6) AS priority FROM pool")
def priority_score(spark, sf):
    overdue = 1_005_000 - F.coalesce("next_poll_at", F.lit(1_000_000))
    p = expr.priority(F.col("priority_score") / 100, F.coalesce("ranked_rank", F.lit(0)) / 25, overdue, F.col("tag") % 3 / 3)
    return bind.pool(spark, sf).select("tag", F.round(p, 6).alias("priority"))


@query(f"WITH {POOL}, g AS (SELECT region, count(*) AS n FROM pool WHERE is_active = 1 GROUP BY region) SELECT region, n, round(0.2 - 0.15 * least(n / 60.0, 1), 3) AS explore, round(1 - round(0.2 - 0.15 * least(n / 60.0, 1), 3), 3) AS exploit FROM g")
def budget_split_fn(spark, sf):
    g = bind.pool(spark, sf).where("is_active = 1").groupBy("region").agg(n_rows().alias("n"))
    share = expr.explore_share("n", 60)
    return g.select("region", "n", share.alias("explore"), F.round(1 - share, 3).alias("exploit"))


@query(
    f"""WITH n AS (SELECT p_partkey AS id, lower(trim(p_name)) AS low, {KEY.format('p_name')} AS j FROM part)
SELECT id, array_to_string(list_sort(list_distinct(list_filter([low, regexp_replace(low, '[^a-z0-9 ]', '', 'g'), trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), j, j || 's', j || '''s', regexp_replace(j, 's$', '')], lambda x: x <> ''))), '|') AS aliases FROM n"""
)
def alias_variants(spark, sf):
    part = bind.table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(text.alias_variants("p_name")), "|").alias("aliases"))


@query(
    r"""WITH x AS (SELECT doc_id, '{{Map|map=' || source || ' <!--x--> |MapType= ' || lang || ' ' || chr(10) || '|score1=' || n_chars || '}}' AS t FROM documents), y AS (SELECT doc_id, regexp_replace(t, '(?s)<!--.*?-->', '', 'g') AS t FROM x)
SELECT doc_id, trim(regexp_extract(t, '(?i)\|\s*map\s*=\s*([^\n|}]*)', 1)) AS map, trim(regexp_extract(t, '(?i)\|\s*maptype\s*=\s*([^\n|}]*)', 1)) AS maptype, trim(regexp_extract(t, '(?i)\|\s*score1\s*=\s*([^\n|}]*)', 1)) AS score1, nullif(regexp_extract(t, '(?i)\|\s*winner\s*=\s*([^\n|}]*)', 1), '') AS winner FROM y"""
)
def template_fields(spark, sf):
    t = F.concat(F.lit("{{Map|map="), "source", F.lit(" <!--x--> |MapType= "), "lang", F.lit(" \n|score1="), F.col("n_chars").cast("string"), F.lit("}}"))
    x = bind.table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return x.select("doc_id", *[text.template_field("t", f).alias(f) for f in ("map", "maptype", "score1", "winner")])


@query(f"WITH {L} SELECT event_id, round(0.7 * latency + 0.3 * (new_matches / 0.25), 6) AS activity FROM l")
def activity_ewma(spark, sf):
    return bind.poll_log(spark, sf).select("event_id", F.round(expr.activity("latency", F.col("new_matches") / 0.25), 6).alias("activity"))


def _mul(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * ({b})) % 4294967296 AS BIGINT)"


@query(
    f"""WITH a AS (SELECT o_orderkey AS k, CAST((CAST(20260805 AS HUGEINT) + {_mul('((o_orderkey + 1) % 4294967296)', '1831565813')}) % 4294967296 AS BIGINT) AS t FROM orders),
b AS (SELECT k, {_mul('xor(t, t >> 15)', 't | 1')} AS t FROM a), c AS (SELECT k, xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) % 4294967296) AS t FROM b) SELECT k, round(xor(t, t >> 14) / 4294967296.0, 9) AS u FROM c"""
)
def counter_random(spark, sf):
    return bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.round(expr.uniform(20260805, F.col("o_orderkey")), 9).alias("u"))
