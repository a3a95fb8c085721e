"""Scores, ban lists and picks under fixed weights, so that any engine can repeat them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trifold.functions.expr import sigmoid
from trifold.operators import decide, masked, ranking
from trifold.plans.registry import query
from trifold.plans.views import D, P
from trifold.session import durable
from trifold.sources import bind

#: Strength of a character and counter weight of two, as SQL.
W = "((({x}) * 37 + 11) % 101 - 50) / 100.0"
C = "((({i}) * 13 + ({j}) * 7) % 11 - (({j}) * 13 + ({i}) * 7) % 11) / 100.0"


def weights(spark):
    return spark.range(bind.N).select(F.col("id").cast("int").alias("brawler_id"), (((F.col("id") * 37 + 11) % 101 - 50) / 100).alias("w"))


def counters(spark):
    i, j = F.col("i"), F.col("j")
    ids = spark.range(bind.N).select(F.col("id").cast("int").alias("i"))
    both = ids.select("i", F.explode(F.sequence(F.lit(0), F.lit(bind.N - 1))).alias("j")).where("i <> j")
    return both.withColumn("w", ((i * 13 + j * 7) % 11 - (j * 13 + i * 7) % 11) / 100)


_W = W.format(x="x")


@query(f"WITH {D}, z AS (SELECT match_id, list_sum(list_transform(a, lambda x: {_W})) - list_sum(list_transform(b, lambda x: {_W})) AS z FROM d) SELECT match_id, round(z, 6) + 0.0 AS z, round(1 / (1 + exp(-z)), 6) AS p FROM z")
def score_drafts(spark, sf):
    s = decide.score(bind.drafts(spark, sf), weights(spark))
    return s.select("match_id", (F.round("z", 6) + 0.0).alias("z"), F.round("p", 6).alias("p"))


BANS = f"""{D}, pk AS (SELECT map_id, match_id % 2 AS half, unnest(list_concat(a, b)) AS brawler_id FROM d), g AS (SELECT map_id, half, brawler_id, count(*) AS n FROM pk GROUP BY ALL),
v AS (SELECT map_id, half, brawler_id, n / CAST(sum(n) OVER (PARTITION BY map_id, half) AS DOUBLE) * greatest({W.format(x='brawler_id')}, 0) AS value FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY map_id, half ORDER BY value DESC, brawler_id) AS rank FROM v)"""


@query(
    f"""WITH {D}, pk AS (SELECT map_id, unnest(list_concat(a, b)) AS brawler_id FROM d), g AS (SELECT map_id, brawler_id, count(*) AS n FROM pk GROUP BY ALL), v AS (SELECT map_id, brawler_id, n / CAST(sum(n) OVER (PARTITION BY map_id) AS DOUBLE) * greatest({W.format(x='brawler_id')}, 0) AS value FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY value DESC, brawler_id) AS rank FROM v) SELECT map_id, brawler_id, round(value, 6) AS value, rank FROM r WHERE rank <= 10"""
)
def ban_ranking(spark, sf):
    r = decide.ban_list(bind.drafts(spark, sf), weights(spark)).where("rank <= 10")
    return r.select("map_id", "brawler_id", F.round("value", 6).alias("value"), "rank")


@query(
    f"""WITH {BANS}, best AS (SELECT map_id, sum(value) AS best FROM r WHERE half = 1 AND rank <= 3 GROUP BY map_id), got AS (SELECT x.map_id, sum(coalesce(y.value, 0)) AS got FROM r x LEFT JOIN r y ON y.half = 1 AND y.map_id = x.map_id AND y.brawler_id = x.brawler_id WHERE x.half = 0 AND x.rank <= 3 GROUP BY x.map_id)
SELECT map_id, round(CASE WHEN best > 0 THEN coalesce(got, 0) / best ELSE 1 END, 6) AS captured FROM best LEFT JOIN got USING (map_id)"""
)
def ban_capture(spark, sf):
    d, w = bind.drafts(spark, sf), weights(spark)
    half = lambda k: decide.ban_list(d.where(F.col("match_id") % 2 == k), w)
    return decide.captured(half(0), half(1), 3).select("map_id", F.round("captured", 6).alias("captured"))


@query(
    f"""WITH {D}, c AS (SELECT match_id, a[3] AS actual, CAST(i AS BIGINT) AS x, {W.format(x='i')} AS w FROM d, range(107) t(i) WHERE NOT list_contains(list_concat(a[1:2], b), i)), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY w DESC, x) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM c)
SELECT match_id, max(n) AS n_free, max(w) AS best, max(CASE WHEN k = floor((n - 1) * 0.5) + 1 THEN w END) AS median, min(w) AS worst, max(CASE WHEN x = actual THEN w END) AS actual, coalesce(max(CASE WHEN x = actual THEN k END), 0) AS actual_rank FROM r GROUP BY match_id"""
)
def pick_value(spark, sf):
    return decide.last_pick(bind.drafts(spark, sf), weights(spark))


@query(
    f"""WITH {D}, x AS (SELECT i, j, {W.format(x='j')} - ({C.format(i='i', j='j')}) AS gain FROM range(107) p(i), range(107) q(j) WHERE i <> j), k AS (SELECT match_id, list_concat(a[1:2], b[1:2]) AS taken FROM d WHERE y IS NOT NULL),
c AS (SELECT match_id, i, max(gain) AS loss FROM k, x WHERE NOT list_contains(taken, i) AND NOT list_contains(taken, j) GROUP BY match_id, i), v AS (SELECT match_id, i, round({W.format(x='i')} - loss, 9) AS value FROM c)
SELECT match_id, min_by(i, (-value, i)) AS pick, round(max(value), 6) AS value FROM v GROUP BY match_id"""
)
def one_ply_response(spark, sf):
    out = decide.best_after_reply(bind.decided(spark, sf), weights(spark), counters(spark))
    return out.select("match_id", F.col("pick").cast("long").alias("pick"), F.round("value", 6).alias("value"))


@query(
    f"""WITH {D}, z AS (SELECT match_id, list_sum(list_transform(a, lambda x: {_W})) - list_sum(list_transform(b, lambda x: {_W})) AS z, a, b FROM d WHERE y IS NOT NULL), q AS (SELECT match_id, unnest(list_concat(a, b)) AS brawler_id, 1 / (1 + exp(-z)) AS p FROM z)
SELECT brawler_id, round(sum(p * (1 - p)), 4) AS information, count(*) AS n FROM q GROUP BY brawler_id"""
)
def fisher_diagonal(spark, sf):
    s = decide.score(bind.decided(spark, sf), weights(spark))
    rows = s.select(F.explode(F.concat("a", "b")).alias("brawler_id"), (sigmoid("z") * (1 - sigmoid("z"))).alias("v"))
    return rows.groupBy("brawler_id").agg(F.round(F.sum("v"), 4).alias("information"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {D}, z AS (SELECT match_id, y, a, b, 1 / (1 + exp(-(list_sum(list_transform(a, lambda x: {_W})) - list_sum(list_transform(b, lambda x: {_W}))))) AS p FROM d WHERE y IS NOT NULL),
s AS (SELECT a AS team, y - p AS e FROM z UNION ALL SELECT b, p - y FROM z), q AS (SELECT unnest(team) AS brawler_id, e FROM s) SELECT brawler_id, count(*) AS n, round(avg(e), 6) AS mean, round(sqrt(avg(e * e)), 6) AS rms FROM q GROUP BY brawler_id"""
)
def solo_residual(spark, sf):
    s = decide.score(bind.decided(spark, sf), weights(spark))
    side = lambda team, e: F.transform(team, lambda x: F.struct(x.alias("brawler_id"), e.alias("e")))
    rows = s.select(F.explode(F.concat(side("a", F.col("y") - F.col("p")), side("b", F.col("p") - F.col("y")))).alias("r")).select("r.*")
    return rows.groupBy("brawler_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rms"))


@query(
    f"""WITH {D}, x AS (SELECT i, j, {W.format(x='j')} - ({C.format(i='i', j='j')}) AS gain FROM range(107) p(i), range(107) q(j) WHERE i <> j), k AS (SELECT match_id, list_concat(a[1:2], b[1:2]) AS taken FROM d WHERE y IS NOT NULL),
c AS (SELECT match_id, i, max(gain) AS loss FROM k, x WHERE NOT list_contains(taken, i) AND NOT list_contains(taken, j) GROUP BY match_id, i), v AS (SELECT match_id, i, {W.format(x='i')} AS w, round({W.format(x='i')} - loss, 9) AS value FROM c),
g AS (SELECT match_id, max(value) AS best, min_by(value, (-w, i)) AS greedy FROM v GROUP BY match_id) SELECT count(*) AS n, round(avg(best - greedy), 6) AS uplift, count(*) FILTER (WHERE greedy < best) AS punished FROM g"""
)
def masked_drafts(spark, sf):
    """Drafts without their last picks: what looking one reply ahead gains over the greedy pick, and how often that one is punished."""
    out = decide.best_after_reply(bind.decided(spark, sf), weights(spark), counters(spark))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("value") - F.col("greedy_value")), 6).alias("uplift"), F.count_if(F.col("greedy_value") < F.col("value")).alias("punished"))


@query()
def ban_stability(spark, sf):
    out = decide.ban_stability(bind.drafts(spark, sf), weights(spark))
    return out.select("map_id", F.round("mean_share", 4).alias("mean_share"), F.round("least_share", 4).alias("least_share"))


@query(
    f"""WITH {D}, {P}, pk AS (SELECT CAST(unnest(list_concat(a, b)) AS INT) AS brawler_id FROM d), v AS (SELECT brawler_id, {W.format(x='brawler_id')} AS w FROM pk GROUP BY brawler_id HAVING count(*) >= 80),
r AS (SELECT player, brawler_id, w, row_number() OVER (PARTITION BY player ORDER BY w DESC, brawler_id) AS rank FROM (SELECT DISTINCT player, brawler_id FROM p) JOIN v USING (brawler_id)) SELECT player, brawler_id, round(w, 6) AS w, rank FROM r WHERE rank <= 3"""
)
def served_picks(spark, sf):
    """The three strongest characters that each player owns, of those picked often enough."""
    picks = bind.drafts(spark, sf).select(F.explode(F.concat("a", "b")).alias("brawler_id"))
    out = decide.served(weights(spark), picks, bind.players(spark, sf), 80).where("rank <= 3")
    return out.select("player", "brawler_id", F.round("w", 6).alias("w"), "rank")


#: The same weights in hundredths, with one for two allies.
_IW, _IC, _IS = "((({x}) * 37 + 11) % 101 - 50)", "((({i}) * 13 + ({j}) * 7) % 11 - (({j}) * 13 + ({i}) * 7) % 11)", "((({i}) * ({j})) % 5 - 2)"


def _pick(name: str, source: str, me: str, plied: bool) -> str:
    """Expressions that add a pick to the list ``me`` of each state, by its gain or by what a reply leaves of it."""
    foe = "other" if me == "own" else "own"
    gain = lambda x, mine, theirs: f"{_IW.format(x=x)} + list_sum(list_transform({mine}, lambda o: {_IS.format(i=x, j='o')})) + list_sum(list_transform({theirs}, lambda o: {_IC.format(i=x, j='o')}))"
    free = "WHERE NOT list_contains(list_concat(own, other), {})"
    out = f"{name}_f AS MATERIALIZED (SELECT match_id, i, {gain('i', me, foe)} AS g FROM {source}, range(107) r(i) {free.format('i')}), "
    if plied:
        out += f"{name}_r AS MATERIALIZED (SELECT match_id, j, {gain('j', foe, me)} AS h FROM {source}, range(107) r(j) {free.format('j')}), {name}_v AS (SELECT f.match_id, i, any_value(g) - max(h - {_IC.format(i='i', j='j')}) AS v FROM {name}_f f JOIN {name}_r r ON f.match_id = r.match_id AND i <> j GROUP BY f.match_id, i), "
    else:
        out += f"{name}_v AS (SELECT match_id, i, g AS v FROM {name}_f), "
    out += f"{name}_o AS MATERIALIZED (SELECT match_id, i, row_number() OVER (PARTITION BY match_id ORDER BY v DESC, i) AS place FROM {name}_v), "
    mine = f"list_append({me}, i) AS {me}"
    return out + f"{name} AS MATERIALIZED (SELECT match_id, {mine}, {foe} FROM {source} JOIN {name}_o USING (match_id) WHERE place = 1), "


def _masked_sql() -> str:
    out, ends = f"WITH {D}, ", []
    for k, start, actual, turns in ((1, "b[1:2] AS own, a AS other", "b[3]", [True]), (2, "a[1:2] AS own, b[1:2] AS other", "a[3]", [True, False]), (3, "a[1:1] AS own, b[1:2] AS other", "a[2]", [True, True, False])):
        out += f"s{k} AS (SELECT match_id, {start} FROM d WHERE y IS NOT NULL), "
        for policy in "gp":
            last = f"s{k}"
            for at, ours in enumerate(turns):
                name = f"{policy}{k}{at}"
                out += _pick(name, last, "own" if ours else "other", ours and policy == "p" and False in turns[at:])
                last = name
            pair = lambda t: f"list_sum(list_transform([[1, 2], [1, 3], [2, 3]], lambda q: {_IS.format(i=f'{t}[q[1]]', j=f'{t}[q[2]]')}))"
            team = lambda t: f"list_sum(list_transform({t}, lambda x: {_IW.format(x='x')}))"
            cross = " + ".join(_IC.format(i=f"own[{i}]", j=f"other[{j}]") for i in (1, 2, 3) for j in (1, 2, 3))
            first = f"{policy}{k}0_o"
            counter = f"(SELECT o.match_id, o.i, max({_IC.format(i='j', j='o.i')}) >= 8 AS punished FROM {first} o JOIN s{k} s ON s.match_id = o.match_id AND o.place = 1, range(107) r(j) WHERE NOT list_contains(list_concat(own, other), j) GROUP BY o.match_id, o.i)"
            out += f"{policy}{k} AS MATERIALIZED (SELECT x.match_id, 1 / (1 + exp(-({team('own')} - {team('other')} + {pair('own')} - {pair('other')} + {cross}) / 100.0)) AS p, punished, (SELECT any_value(place) FROM {first} o WHERE o.match_id = x.match_id AND o.i = {actual}) AS place FROM {last} x JOIN {counter} c ON c.match_id = x.match_id JOIN d ON d.match_id = x.match_id), "
        share = lambda c: f"round(avg(CAST({c} AS INT)), 6)"
        ends.append(f"SELECT {k} AS masked, count(*) AS n, round(avg(p.p - g.p), 6) + 0.0 AS uplift, {share('g.punished')} AS greedy_punished, {share('p.punished')} AS plied_punished, {share('g.place <= 5')} AS greedy_agrees, {share('p.place <= 5')} AS plied_agrees FROM g{k} g JOIN p{k} p USING (match_id)")
    return out[:-2] + " " + " UNION ALL ".join(ends)


def tables():
    """Strengths, allies' and counters' weights over ids, as arrays."""
    x = np.arange(bind.N)
    i, j = x[:, None], x[None]
    return ((x * 37 + 11) % 101 - 50) / 100, (i * j % 5 - 2) / 100, ((i * 13 + j * 7) % 11 - (j * 13 + i * 7) % 11) / 100


@query(_masked_sql())
def masked_completions(spark, sf):
    """Drafts with their last one to three picks open, finished greedily and looking a reply ahead, against a fixed adversary."""
    d, model = bind.decided(spark, sf), tables()
    out = None
    for k in (1, 2, 3):
        s = masked.summary(masked.completed(d, *model, k, 0.08)).select(F.lit(k).alias("masked"), "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("uplift", "greedy_punished", "plied_punished", "greedy_agrees", "plied_agrees")])
        out = s if out is None else out.unionByName(s)
    return out


_WM = f"(({W.format(x='brawler_id')}) + ((map_id * 7 + brawler_id * 3) % 21 - 10) / 100.0)"


@query(
    f"""WITH {D}, pk AS (SELECT map_id, match_id % 2 AS half, (match_id * 2654435761) % 4294967296 / 4294967296.0 AS draw, unnest(list_concat(a, b)) AS brawler_id FROM d), pop AS (SELECT brawler_id, row_number() OVER (ORDER BY count(*) DESC, brawler_id) AS pl, count(*) OVER () AS ids FROM pk GROUP BY brawler_id),
big AS (SELECT map_id FROM pk GROUP BY map_id HAVING count(*) >= 120), z(size) AS (VALUES (0.25::DOUBLE), (0.5), (1)), n AS (SELECT map_id, size, half, brawler_id, count(*) AS n FROM pk JOIN z ON draw < size WHERE map_id IN (FROM big) GROUP BY ALL),
v AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY map_id, size, half) AS DOUBLE) * greatest({_WM}, 0) AS v FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY map_id, size, half ORDER BY v DESC, brawler_id) AS r FROM v),
t AS (SELECT map_id, size, sum(v) FILTER (WHERE r <= 3) AS best, sum(v) AS every, sum(n) / 6 AS n2 FROM r WHERE half = 1 GROUP BY ALL), o AS (SELECT x.map_id, x.size, sum(x.n) / 6 AS n1, count(*) FILTER (WHERE x.r <= 3 AND y.r <= 3) / 3 AS o1, count(*) FILTER (WHERE x.r <= 5 AND y.r <= 5) / 5 AS o2, coalesce(sum(y.v) FILTER (WHERE x.r <= 3), 0) AS got FROM r x LEFT JOIN r y ON y.half = 1 AND y.map_id = x.map_id AND y.size = x.size AND y.brawler_id = x.brawler_id WHERE x.half = 0 GROUP BY ALL),
p AS (SELECT map_id, size, coalesce(sum(v) FILTER (WHERE pl <= 3), 0) AS pop, any_value(ids) AS ids FROM r JOIN pop USING (brawler_id) WHERE half = 1 GROUP BY ALL)
SELECT size, count(*) AS maps, CAST(sum(n1) AS BIGINT) AS n_first, CAST(sum(n2) AS BIGINT) AS n_second, round(avg(o1), 6) AS overlap3, round(avg(o2), 6) AS overlap5, round(avg(CASE WHEN best > 0 THEN got / best ELSE 1 END), 6) AS captured, round(avg(CASE WHEN best > 0 THEN pop / best ELSE 1 END), 6) AS popular, round(avg(CASE WHEN best > 0 THEN every * 3 / ids / best ELSE 1 END), 6) AS random FROM t JOIN o USING (map_id, size) JOIN p USING (map_id, size) GROUP BY size"""
)
def ban_agreement(spark, sf):
    """Ban lists of two halves under fixed strengths by map, at three nested sizes, beside the lists of the most picked and of random characters."""
    d = bind.drafts(spark, sf)
    own = weights(spark).crossJoin(F.broadcast(d.select("map_id").distinct()))
    strengths = own.select("map_id", "brawler_id", (F.col("w") + ((F.col("map_id") * 7 + F.col("brawler_id") * 3) % 21 - 10) / 100).alias("w"))
    draw = F.col("match_id") * 2654435761 % 4294967296 / 4294967296
    return rounded(decide.agreement(d, strengths, [0.25, 0.5, 1.0], F.col("match_id") % 2, draw, least=20))


def rounded(out):
    out = out.withColumnsRenamed({"overlap1": "overlap3", "overlap2": "overlap5"})
    return out.select("size", "maps", "n_first", "n_second", *[F.round(c, 6).alias(c) for c in ("overlap3", "overlap5", "captured", "popular", "random")])


_WMODE = f"({W.format(x='{x}')} + ((ascii(mode) * 5 + ({{x}}) * 3) % 21 - 10) / 100.0)"
CHANCES = f"""{D}, sv AS (SELECT i, count(*) >= 80 AS served FROM (SELECT unnest(list_concat(a, b)) AS i FROM d) GROUP BY i), c AS (SELECT match_id, mode, a[3] AS actual, i, round(1 / (1 + exp(-({_WMODE.format(x='a[1]')} + {_WMODE.format(x='a[2]')} - {' - '.join(_WMODE.format(x=f'b[{k}]') for k in (1, 2, 3))} + {_WMODE.format(x='i')}))), 9) AS p FROM d, sv WHERE served AND (i = a[3] OR NOT list_contains(list_concat(a, b), i))),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, i) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM c), g AS (SELECT match_id, mode, any_value(n) AS n_free, max(p) AS best, max(CASE WHEN k = n // 2 + 1 THEN p END) AS median, avg(p) AS mean, min(p) AS worst, max(CASE WHEN i = actual THEN k END) AS actual_rank FROM r WHERE n >= 20 GROUP BY match_id, mode)"""


def _last_picks(spark, sf):
    d = bind.drafts(spark, sf)
    n = d.select(F.explode(F.concat("a", "b")).alias("brawler_id")).groupBy("brawler_id").agg((F.count(F.lit(1)) >= 80).alias("served"))
    each = weights(spark).join(n, "brawler_id", "left").crossJoin(F.broadcast(d.select("mode").distinct()))
    w = F.col("w") + ((F.ascii("mode") * 5 + F.col("brawler_id") * 3) % 21 - 10) / 100
    return decide.pick_chances(d, each.select("mode", "brawler_id", w.alias("w"), F.coalesce("served", F.lit(False)).alias("served")), "mode")


@query(
    f"""WITH {CHANCES}, u AS (SELECT mode, unnest(['range', 'over mean', 'over median']) AS measure, unnest([round(best - worst, 6), round(best - mean, 6), round(best - median, 6)]) AS value FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY mode, measure ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY mode, measure) AS n FROM u)
SELECT mode, measure, p, value FROM o, (VALUES (0.1::DOUBLE), (0.5), (0.9)) q(p) WHERE i = floor(p * (n - 1))"""
)
def pick_spread(spark, sf):
    """By mode, how far the best last pick lies above the worst, the mean and the median one, as chances: low, middle and high places over matches."""
    gap = lambda name, c: F.struct(F.lit(name).alias("measure"), F.round(F.col("best") - F.col(c), 6).alias("value"))
    each = _last_picks(spark, sf).select("mode", F.explode(F.array(gap("range", "worst"), gap("over mean", "mean"), gap("over median", "median"))).alias("x")).select("mode", "x.*")
    return ranking.order_statistic(durable(each), "value", [0.1, 0.5, 0.9], ["mode", "measure"])


@query(f"WITH {CHANCES} SELECT mode, count(*) AS n, count(actual_rank) AS n_ranked, {', '.join(f'round(avg(CASE WHEN actual_rank IS NOT NULL THEN CAST(actual_rank <= {k} AS INT) END), 6) AS top{k}' for k in (1, 3, 5, 10))}, round(avg((actual_rank - 1) / CAST(n_free - 1 AS DOUBLE)), 6) AS place FROM g GROUP BY mode")
def pick_hits(spark, sf):
    """By mode, how often the actual last pick is among the model's first ones, and its mean place from 0 to 1."""
    rank = F.col("actual_rank")
    return _last_picks(spark, sf).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count(rank).alias("n_ranked"), *[F.round(F.avg((rank <= k).cast("int")), 6).alias(f"top{k}") for k in (1, 3, 5, 10)], F.round(F.avg((rank - 1) / (F.col("n_free") - 1)), 6).alias("place"))
