"""Compositions, pairs, claims, seats and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trifold.functions.expr import n_rows, share_error
from trifold.operators import comps, corpus, design, pairs, ranking
from trifold.plans.registry import query
from trifold.plans.views import CLASS, D, S, SHORT, wilson
from trifold.sources import bind

LOW, HIGH = wilson("wins", "n")
ROLES = f"{S}, q AS (SELECT *, list_transform(team, lambda x: {CLASS}[x % 7 + 1]) AS classes, list_sort(list_transform(team, lambda x: {SHORT}[x % 7 + 1])) AS short FROM s), r AS (SELECT *, len(list_distinct(classes)) AS coverage, 4 - greatest(len(list_distinct(classes)), 1) AS redundancy, array_to_string(short, '+') AS comp FROM q)"


def _sides(spark, sf):
    return pairs.sides(bind.decided(spark, sf))


def _rates(by, *keys):
    return by.select(*keys, "n", "wins", F.round("rate", 6).alias("rate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _sql(key: str, having: str = "") -> str:
    return f"WITH {ROLES}, g AS (SELECT {key}, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins FROM r GROUP BY ALL {having}) SELECT {key}, n, wins, round(wins / CAST(n AS DOUBLE), 6) AS rate, round({LOW}, 6) AS low, round({HIGH}, 6) AS high FROM g"


@query(_sql("coverage"))
def role_coverage_wilson(spark, sf):
    return _rates(comps.win_rate(comps.with_roles(_sides(spark, sf)), F.col("coverage").cast("long").alias("coverage")), "coverage")


@query(_sql("redundancy"))
def role_redundancy(spark, sf):
    return _rates(comps.win_rate(comps.with_roles(_sides(spark, sf)), F.col("redundancy").cast("long").alias("redundancy")), "redundancy")


@query(_sql("comp, mode", "HAVING count(*) >= 30"))
def comp_winrate(spark, sf):
    return _rates(comps.win_rate(comps.with_roles(_sides(spark, sf)), "comp", "mode", least=30), "comp", "mode")


L1, H1 = wilson("k1", "n1")
L0, H0 = wilson("k0", "n0")


@query(
    f"""WITH {ROLES}, arms AS (SELECT 'tank everywhere' AS claim, list_contains(classes, 'tank') AS f, won FROM r UNION ALL SELECT 'full coverage on odd maps', coverage = 3, won FROM r WHERE map_id % 2 = 1 UNION ALL SELECT 'double marksman', len(list_filter(classes, lambda x: x = 'marksman')) >= 2, won FROM r),
g AS (SELECT claim, count(*) FILTER (WHERE f) AS n1, CAST(sum(CASE WHEN f THEN won ELSE 0 END) AS BIGINT) AS k1, count(*) FILTER (WHERE NOT f) AS n0, CAST(sum(CASE WHEN f THEN 0 ELSE won END) AS BIGINT) AS k0 FROM arms GROUP BY claim)
SELECT claim, n1, k1, n0, k0, CASE WHEN n1 < 20 OR n0 < 20 THEN 'too few' WHEN {L1} > {H0} THEN 'higher' WHEN {H1} < {L0} THEN 'lower' ELSE 'overlap' END AS verdict, CASE WHEN n1 >= 20 AND n0 >= 20 THEN round(k1 / CAST(n1 AS DOUBLE) - k0 / CAST(n0 AS DOUBLE), 6) END AS diff FROM g"""
)
def claim_two_arm(spark, sf):
    tank, cover = F.array_contains("classes", "tank"), F.col("coverage") == 3
    double = F.size(F.filter("classes", lambda x: x == "marksman")) >= 2
    claims = [("tank everywhere", F.lit(True), tank), ("full coverage on odd maps", F.col("map_id") % 2 == 1, cover), ("double marksman", F.lit(True), double)]
    return comps.two_arms(comps.with_roles(_sides(spark, sf)), claims).select("claim", "n1", "k1", "n0", "k0", "verdict", F.round("diff", 6).alias("diff"))


@query(
    f"""WITH {ROLES}, u AS (SELECT won - 0.5 AS e, short, list_sort(list_distinct(short)) AS d FROM r), x AS (SELECT 'triple' AS family, array_to_string(short, '+') AS label, e FROM u UNION ALL SELECT 'single', unnest(d), e FROM u
 UNION ALL SELECT 'pair', p1 || '+' || p2, e FROM (SELECT e, unnest(d) AS p1, d FROM u) y, unnest(d) AS t(p2) WHERE p1 < p2) SELECT family, label, count(*) AS n, round(avg(e), 6) AS mean FROM x GROUP BY ALL"""
)
def comp_membership_residual(spark, sf):
    rows = comps.with_roles(_sides(spark, sf)).withColumn("residual", F.col("won") - 0.5)
    return comps.family_residuals(rows).withColumn("mean", F.round("mean", 6))


PAIRS = f"{S}, pr AS (SELECT match_id, won, least(team[i], team[j]) AS i, greatest(team[i], team[j]) AS j FROM s, (VALUES (1, 2), (1, 3), (2, 3)) v(i, j))"


@query(f"WITH {PAIRS} SELECT i, j, count(*) AS n, round(sum(won - 0.5), 6) AS total, round(avg(won - 0.5), 6) AS mean FROM pr GROUP BY ALL")
def pair_residual(spark, sf):
    rows = _sides(spark, sf).select((F.col("won") - 0.5).alias("e"), F.explode(pairs.same_team("team")).alias("p"))
    by = pairs.residual_means(rows.select("e", "p.i", "p.j"), ["i", "j"], "e")
    return by.select("i", "j", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query(f"WITH {PAIRS} SELECT i, j, count(*) AS n FROM pr GROUP BY ALL ORDER BY n DESC, i, j LIMIT 40")
def pair_cooccurrence_topk(spark, sf):
    return pairs.co_occurrence(bind.decided(spark, sf)).orderBy(F.desc("n"), "i", "j").limit(40)


@query(
    f"""WITH {PAIRS}, c AS (SELECT i, j, count(*) AS n FROM pr GROUP BY ALL), dom AS (SELECT x.i AS i, y.j AS j FROM range(107) x(i), range(107) y(j) WHERE x.i < y.j), a AS (SELECT coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0)) - 1 AS k FROM dom LEFT JOIN c USING (i, j))
SELECT count(*) FILTER (WHERE n > 0) AS seen, count(*) AS pairs, max(n) AS most, max(n) FILTER (WHERE k = 2835) AS median, max(n) FILTER (WHERE k = 5103) AS p90, round(avg(n), 6) AS mean FROM a"""
)
def pair_statistics(spark, sf):
    counts = pairs.co_occurrence(bind.decided(spark, sf))
    rows = pairs.pair_domain(spark, bind.N).join(counts, ["i", "j"], "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    by = ranking.order_statistic(rows, "n", [0.5, 0.9])
    q = by.groupBy().agg(F.max(F.when(F.col("p") == 0.5, F.col("n"))).alias("median"), F.max(F.when(F.col("p") == 0.9, F.col("n"))).alias("p90"))
    one = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("seen"), n_rows().alias("pairs"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    return one.crossJoin(F.broadcast(q))


@query(f"WITH {S} SELECT array_to_string(list_sort(team), ',') AS triple, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins FROM s GROUP BY 1 HAVING count(*) >= 2")
def triple_counts(spark, sf):
    by = _sides(spark, sf).groupBy(pairs.triple("team").alias("triple")).agg(n_rows().alias("n"), F.sum("won").cast("long").alias("wins"))
    return by.where("n >= 2")


@query(f"WITH {D}, x AS (SELECT match_id, y, p1, p2, CASE WHEN p1 < p2 THEN 1 ELSE -1 END AS sign FROM (SELECT match_id, y, unnest(a) AS p1, b FROM d WHERE y IS NOT NULL) q, unnest(b) AS t(p2) WHERE p1 <> p2) SELECT least(p1, p2) AS i, greatest(p1, p2) AS j, count(*) AS n, CAST(sum(sign * (2 * y - 1)) AS BIGINT) AS balance FROM x GROUP BY ALL")
def counter_pairs(spark, sf):
    rows = bind.decided(spark, sf).select("y", F.explode(pairs.cross_team("a", "b")).alias("p"))
    rows = rows.select(F.least("p.ours", "p.theirs").alias("i"), F.greatest("p.ours", "p.theirs").alias("j"), (F.col("p.sign") * (2 * F.col("y") - 1)).alias("v"))
    return rows.groupBy("i", "j").agg(n_rows().alias("n"), F.sum("v").cast("long").alias("balance"))


@query(f"WITH {D}, pk AS (SELECT map_id, unnest(list_concat(a, b)) AS brawler_id FROM d), g AS (SELECT map_id, brawler_id, count(*) AS n FROM pk GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY map_id) AS slots FROM g) SELECT map_id, brawler_id, n, round(n / CAST(slots AS DOUBLE), 6) AS share, round(sqrt((n / CAST(slots AS DOUBLE)) * (1 - n / CAST(slots AS DOUBLE)) / slots), 6) AS error FROM t")
def ban_share_per_map(spark, sf):
    picks = bind.drafts(spark, sf).select("map_id", F.explode(F.concat("a", "b")).alias("brawler_id"))
    g = picks.groupBy("map_id", "brawler_id").agg(n_rows().alias("n"))
    t = g.withColumn("slots", F.sum("n").over(Window.partitionBy("map_id")))  # characters by maps
    share = F.col("n") / F.col("slots")
    return t.select("map_id", "brawler_id", "n", F.round(share, 6).alias("share"), F.round(share_error(share, F.col("slots") / 6), 6).alias("error"))


@query(f"WITH {D}, pk AS (SELECT map_id, unnest(list_concat(a, b)) AS brawler_id FROM d), g AS (SELECT map_id, brawler_id, count(*) AS n FROM pk GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY map_id) AS slots, sum(n) OVER (PARTITION BY brawler_id) / CAST(sum(n) OVER () AS DOUBLE) AS prior FROM g) SELECT map_id, brawler_id, round((n + 500 * prior) / (slots + 500), 6) AS shrunk FROM t")
def map_ban_prior(spark, sf):
    picks = bind.drafts(spark, sf).select("map_id", F.explode(F.concat("a", "b")).alias("brawler_id"))
    g = picks.groupBy("map_id", "brawler_id").agg(n_rows().alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    t = g.withColumn("slots", F.sum("n").over(Window.partitionBy("map_id"))).withColumn("own", F.sum("n").over(Window.partitionBy("brawler_id")))
    prior = F.col("own") / F.col("total")
    return t.crossJoin(F.broadcast(total)).select("map_id", "brawler_id", F.round((F.col("n") + 500 * prior) / (F.col("slots") + 500), 6).alias("shrunk"))


@query(f"WITH {D}, g AS (SELECT mode, count(*) AS n, avg(y) AS r FROM d WHERE y IS NOT NULL GROUP BY mode) SELECT mode, n, round(r, 6) AS rate, round(r - 1.96 * sqrt(r * (1 - r) / n), 6) AS low, round(r + 1.96 * sqrt(r * (1 - r) / n), 6) AS high FROM g")
def seat_effect(spark, sf):
    g = bind.decided(spark, sf).groupBy("mode").agg(n_rows().alias("n"), F.avg("y").alias("r"))
    half = 1.96 * F.sqrt(F.col("r") * (1 - F.col("r")) / F.col("n"))
    return g.select("mode", "n", F.round("r", 6).alias("rate"), F.round(F.col("r") - half, 6).alias("low"), F.round(F.col("r") + half, 6).alias("high"))


@query(f"WITH {D}, g AS (SELECT count(*) AS n, avg(y) AS r FROM d WHERE y IS NOT NULL) SELECT n, round(r, 6) AS rate, round(sqrt(0.25 / n), 6) AS error, round((r - 0.5) / sqrt(0.25 / n), 6) AS z FROM g")
def base_rate_z(spark, sf):
    g = bind.decided(spark, sf).agg(n_rows().alias("n"), F.avg("y").alias("r"))
    error = F.sqrt(0.25 / F.col("n"))
    return g.select("n", F.round("r", 6).alias("rate"), F.round(error, 6).alias("error"), F.round((F.col("r") - 0.5) / error, 6).alias("z"))


def _diff(f: str) -> str:
    return f"({f.format(x='ca')}) - ({f.format(x='cb')})"


THEORY = [(f"theory:{c}", _diff("len(list_filter({x}, lambda q: q = '" + c + "'))")) for c in ["damage", "controller", "assassin", "tank", "support", "marksman", "artillery"]]
THEORY += [("theory:coverage", _diff("len(list_distinct({x}))")), ("theory:redundancy", _diff("4 - len(list_distinct({x}))"))]
HAS = "CASE WHEN list_contains({x}, 'artillery') AND NOT list_contains({o}, 'artillery') THEN 1 ELSE 0 END"
THEORY.append(("theory:artillery_only", f"{HAS.format(x='ca', o='cb')} - {HAS.format(x='cb', o='ca')}"))
HUNT = "len(list_filter({x}, lambda q: q = 'assassin')) * len(list_filter({o}, lambda q: q IN ('artillery', 'marksman')))"
THEORY.append(("theory:hunt", f"{HUNT.format(x='ca', o='cb')} - {HUNT.format(x='cb', o='ca')}"))


@query(
    f"WITH {D}, k AS (SELECT match_id, list_transform(a, lambda x: {CLASS}[x % 7 + 1]) AS ca, list_transform(b, lambda x: {CLASS}[x % 7 + 1]) AS cb FROM d WHERE y IS NOT NULL), x AS ("
    + " UNION ALL ".join(f"SELECT match_id, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM k" for n, e in THEORY)
    + ") SELECT * FROM x WHERE value <> 0"
)
def theory_features(spark, sf):
    return design.rows(bind.decided(spark, sf), ["theory"])


TRAITS = [("open", "((map_id * 7 + 3) % 11 - 5) / 5.0"), ("cover", "((map_id * 4 + 1) % 9 - 4) / 4.0")]


@query(
    f"WITH {D}, k AS (SELECT map_id, list_transform(a, lambda x: {CLASS}[x % 7 + 1]) AS ca, list_transform(b, lambda x: {CLASS}[x % 7 + 1]) AS cb FROM d WHERE y IS NOT NULL), x AS ("
    + " UNION ALL ".join(f"SELECT 'structure:{t}:{n[7:]}' AS feature, ({e}) * {trait} AS value FROM k" for n, e in THEORY[:7] for t, trait in TRAITS)
    + ") SELECT feature, count(*) AS n, round(sum(value), 6) + 0.0 AS total, round(sum(abs(value)), 6) AS size FROM x WHERE value <> 0 GROUP BY feature"
)
def structure_features(spark, sf):
    """Class counts against what the map is like: in how many matches each feature stands, its sum and its size."""
    rows = design.rows(bind.decided(spark, sf).withColumns(bind.map_traits()), ["structure"])
    return rows.groupBy("feature").agg(n_rows().alias("n"), (F.round(F.sum("value"), 6) + 0.0).alias("total"), F.round(F.sum(F.abs("value")), 6).alias("size"))


@query(
    f"""WITH {D}, e AS (SELECT match_id, 'solo:' || x AS feature, v AS value FROM (SELECT match_id, unnest(a) AS x, 1 AS v FROM d WHERE y IS NOT NULL UNION ALL SELECT match_id, unnest(b), -1 FROM d WHERE y IS NOT NULL)
 UNION ALL SELECT match_id, 'ctr:' || (least(p1, p2) * (213 - least(p1, p2)) // 2 + greatest(p1, p2) - least(p1, p2) - 1), CASE WHEN p1 < p2 THEN 1 ELSE -1 END FROM (SELECT match_id, unnest(a) AS p1, b FROM d WHERE y IS NOT NULL) q, unnest(b) AS t(p2) WHERE p1 <> p2)
SELECT feature, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT match_id, feature, sum(value) AS value FROM e GROUP BY ALL HAVING sum(value) <> 0) GROUP BY feature"""
)
def design_rows(spark, sf):
    return design.rows(bind.decided(spark, sf), ["solo", "counter"]).groupBy("feature").agg(n_rows().alias("n"), F.sum("value").alias("total"))


@query(
    f"""WITH {D}, x AS (SELECT match_id, p1, sum(((p1 * 13 + p2 * 7) % 11) - ((p2 * 13 + p1 * 7) % 11)) AS lane FROM (SELECT match_id, unnest(a) AS p1, b FROM d WHERE y IS NOT NULL) q, unnest(b) AS t(p2) GROUP BY match_id, p1)
SELECT match_id, CAST(min(lane) AS BIGINT) AS worst, CAST(max(lane) AS BIGINT) AS best, CAST(sum(lane) AS BIGINT) AS total, count(*) FILTER (WHERE lane < 0) AS negative FROM x GROUP BY match_id"""
)
def lane_stats(spark, sf):
    # The counter weight of two picks is an antisymmetric integer formula here, so any engine can repeat it.
    w = lambda i, j: (i * 13 + j * 7) % 11 - (j * 13 + i * 7) % 11
    lane = F.transform("a", lambda x: F.aggregate("b", F.lit(0).cast("long"), lambda acc, z: acc + w(x, z)))
    d = bind.decided(spark, sf).withColumn("lane", lane)
    total = F.aggregate("lane", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.select("match_id", F.array_min("lane").alias("worst"), F.array_max("lane").alias("best"), total.alias("total"), F.size(F.filter("lane", lambda x: x < 0)).cast("long").alias("negative"))


CO = f"{D}, pr AS (SELECT CASE WHEN p1 < p2 THEN p1 ELSE p2 END AS i, CASE WHEN p1 < p2 THEN p2 ELSE p1 END AS j, CASE WHEN p1 < p2 THEN 2 * y - 1 ELSE 1 - 2 * y END AS v FROM (SELECT y, unnest(a) AS p1, b FROM d WHERE y IS NOT NULL) q, unnest(b) AS t(p2) WHERE p1 <> p2), c AS (SELECT i, j, avg(v) AS w FROM pr GROUP BY ALL), f AS (SELECT i, j, w FROM c UNION ALL SELECT j, i, -w FROM c), r AS (SELECT i, sum(w) / 107 AS r FROM f GROUP BY i)"


@query(f"WITH {CO} SELECT i, round(r, 6) AS row_mean FROM r")
def projection_rowsums(spark, sf):
    """What of the counters is a strength in disguise: the row means of the antisymmetric matrix."""
    return _row_means(spark, sf)[1].select("i", F.round("r", 6).alias("row_mean"))


def _row_means(spark, sf):
    rows = bind.decided(spark, sf).select("y", F.explode(pairs.cross_team("a", "b")).alias("p"))
    v = F.col("p.sign") * (2 * F.col("y") - 1)
    c = rows.groupBy(F.least("p.ours", "p.theirs").alias("i"), F.greatest("p.ours", "p.theirs").alias("j")).agg(F.avg(v).alias("w"))
    both = c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("w")).alias("w")))
    return both, both.groupBy("i").agg((F.sum("w") / bind.N).alias("r"))


@query(f"WITH {CO}, p AS (SELECT f.i, f.j, w, x.r - y.r AS solo FROM f JOIN r x ON x.i = f.i JOIN r y ON y.i = f.j) SELECT round(sum(solo * solo) / sum(w * w), 6) AS confounded, round(max(abs(w - solo)), 6) AS largest_left FROM p")
def confounded_share(spark, sf):
    both, r = _row_means(spark, sf)
    p = both.join(r, "i").join(r.select(F.col("i").alias("j"), F.col("r").alias("r2")), "j").withColumn("solo", F.col("r") - F.col("r2"))
    s = F.col("solo")
    return p.agg(F.round(F.sum(s * s) / F.sum(F.col("w") * F.col("w")), 6).alias("confounded"), F.round(F.max(F.abs(F.col("w") - s)), 6).alias("largest_left"))


@query()
def side_swap(spark, sf):
    """Base rate by side before and after random exchange of the sides; tests/ hold it near one half."""
    d = bind.decided(spark, sf)
    s = corpus.swap_sides(d)
    return d.agg(n_rows().alias("n"), F.avg("y").alias("before")).crossJoin(s.agg(F.avg("y").alias("after")))


@query(f"WITH {S}, x AS (SELECT mode, unnest(team) AS id, won - 0.5 AS e FROM s), c AS (SELECT mode, id, avg(e) AS beta FROM x GROUP BY ALL), mv AS (SELECT id, avg(beta) AS shift FROM c GROUP BY id) SELECT 'solo:' || id AS feature, round(shift, 6) + 0.0 AS beta FROM mv UNION ALL SELECT 'solo_mode:' || mode || ':' || id, round(beta - shift, 6) + 0.0 FROM c JOIN mv USING (id)")
def hierarchy_sweep(spark, sf):
    """Cell means of modes swept into the characters' own effects."""
    from trifold.operators import fit

    x = _sides(spark, sf).select("mode", F.explode("team").alias("id"), (F.col("won") - 0.5).alias("e"))
    c = x.groupBy("mode", "id").agg(F.avg("e").alias("beta"))
    c = c.select(F.concat_ws(":", F.lit("solo_mode"), "mode", F.col("id").cast("string")).alias("feature"), "beta")
    return fit.sweep(c, "solo_mode", "solo").select("feature", (F.round("beta", 6) + 0.0).alias("beta"))


@query(f"WITH p AS (SELECT {CLASS}[p_partkey % 7 + 1] AS class, p_retailprice AS v FROM part), g AS (SELECT class, avg(v) AS mean FROM p GROUP BY class) SELECT x.class AS a, y.class AS b, round(x.mean / y.mean, 6) AS ratio, x.mean > 1.01 * y.mean AS above FROM g x, g y WHERE x.class <> y.class")
def class_ratio(spark, sf):
    p = bind.table(spark, sf, "part").select(bind.class_of(F.col("p_partkey")).alias("class"), F.col("p_retailprice").alias("v"))
    g = p.groupBy("class").agg(F.avg("v").alias("mean"))  # seven classes
    other = F.broadcast(g.select(F.col("class").alias("b"), F.col("mean").alias("m2")))
    pairs_ = g.join(other, F.col("class") != F.col("b"))
    return pairs_.select(F.col("class").alias("a"), "b", F.round(F.col("mean") / F.col("m2"), 6).alias("ratio"), (F.col("mean") > 1.01 * F.col("m2")).alias("above"))


@query(f"WITH {S}, g AS (SELECT map_id, unnest(other) AS ban FROM s), c AS (SELECT map_id, ban, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY n DESC, ban) AS k, sum(n) OVER (PARTITION BY map_id) AS total FROM c) SELECT map_id, round(sum(n) FILTER (WHERE k <= 3) / max(total), 6) AS top3, CAST(max(total) AS BIGINT) AS n FROM r WHERE total >= 40 GROUP BY map_id")
def ban_rates(spark, sf):
    c = _sides(spark, sf).select("map_id", F.explode("other").alias("ban")).groupBy("map_id", "ban").agg(n_rows().alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("n"), "ban")))  # characters by maps
    g = r.groupBy("map_id").agg(F.sum(F.when(F.col("k") <= 3, F.col("n"))).alias("top"), F.sum("n").alias("n"))
    return g.where("n >= 40").select("map_id", F.round(F.col("top") / F.col("n"), 6).alias("top3"), "n")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS u, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: u[i] * w[i])), 4) AS sym, round(list_sum(list_transform(range(1, 33), lambda i: u[i] * w[i + 32] - u[i + 32] * w[i])), 4) AS anti FROM p"""
)
def bilinear_scores(spark, sf):
    """Factorised pair effects: a symmetric form for allies and an antisymmetric one for opponents."""
    e = bind.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w")), "vec_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
    left, right = (lambda c: F.slice(c, 1, 32)), (lambda c: F.slice(c, 33, 32))
    anti = dot(left("u"), right("w")) - dot(right("u"), left("w"))
    return p.select("vec_id", F.round(dot("u", "w"), 4).alias("sym"), F.round(anti, 4).alias("anti"))


@query("SELECT doc_id AS claim_id, coalesce(lang, 'und') AS type, coalesce(quality, 1) AS confidence, CASE WHEN quality IS NULL THEN 'seed' ELSE 'checked' END AS durability FROM documents LEFT JOIN labels USING (doc_id)")
def claim_defaults(spark, sf):
    from trifold.operators import textkb

    d = bind.table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("type"))
    q = bind.table(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), F.col("quality").alias("confidence"), F.lit("checked").alias("durability"))
    return textkb.with_defaults(d.join(q, "claim_id", "left"), {"type": "und", "confidence": 1, "durability": "seed"})
