"""Fits and inference; iterative, so beyond SQL and held by tests instead."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from trifold.functions.expr import decay, p_of_interval, sigmoid
from trifold.operators import comps, decide, design, factors, fit, lanes, lookup, metrics, pairs, power, ranking, resample, rollout
from trifold.plans.decisions import rounded
from trifold.plans.registry import query
from trifold.plans.views import D
from trifold.session import durable
from trifold.sources import bind


def _ranked(spark, sf, share: float = 0.8):
    """Decided drafts with their place rn in time, found by distributed ranks, and the last place of the train part."""
    d = bind.decided(spark, sf).select("match_id", "mode", "map_id", "t", "a", "b", "y")
    d = durable(ranking.row_number(d, [F.col("t"), F.col("match_id")]))
    return d, int(d.count() * share)


def _split(spark, sf, share: float = 0.8):
    """Train and test by time."""
    d, cut = _ranked(spark, sf, share)
    return d.where(F.col("rn") <= cut), d.where(F.col("rn") > cut)


def _quality(scored, w=None, **labels):
    out = metrics.losses(scored, w=w).crossJoin(metrics.auc(scored, w=w).select("auc"))
    return out.select(*[F.lit(v).alias(k) for k, v in labels.items()], "n", F.round("log_loss", 5).alias("log_loss"), F.round("auc", 5).alias("auc"))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _context(spark, sf, families=None):
    """Train and test with what the further families read: patch, tier, power, mastery, hour, the map's traits and popularity; of these
    only what ``families`` read, if they are named.

    Popularity is learned from the train part alone."""
    d, cut = _ranked(spark, sf)
    asked = set(design.reads(families)) if families is not None else {"power", "mastery", "tier", "popularity", "patch", "hour", *bind.TRAITS}
    side = lambda k, c: F.avg(F.when(F.col("team_idx") == k, F.col(c)))
    ps, joined = bind.players(spark, sf), []
    means = {"power": lambda: side(0, "power") - side(1, "power"), "mastery": lambda: F.log1p(side(0, "trophies")) - F.log1p(side(1, "trophies"))}
    own = [make().alias(c) for c, make in means.items() if c in asked]
    if own:
        joined.append(ps.groupBy("match_id").agg(*own))
    if "tier" in asked:
        known = bind.pool(spark, sf).where("ranked_rank IS NOT NULL").select(F.col("tag").alias("player"), "ranked_rank")
        ranks = ps.join(known, "player").groupBy("match_id").agg(F.sort_array(F.collect_list("ranked_rank")).alias("r"))  # one match's players
        joined.append(ranks.select("match_id", F.least(F.floor(F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int")) / 6), F.lit(3)).cast("int").alias("tier")))
    if "patch" in asked:
        d = lookup.interval(d, bind.patches(spark), "t", ["patch_id"]).withColumnRenamed("patch_id", "patch")
    traits = bind.map_traits()
    d = d.withColumns({k: c for k, c in {"hour": bind.hour(), **traits}.items() if k in asked})
    if "popularity" in asked:
        picks = d.where(F.col("rn") <= cut).select(F.explode(F.concat("a", "b")).alias("k")).groupBy("k").count()
        rate = dict.fromkeys(range(bind.N), 1) | {r["k"]: r["count"] + 1 for r in picks.collect()}  # parameters, not rows
        total = sum(rate.values())
        logs = F.array(*[F.lit(math.log(rate[k] / total)) for k in range(bind.N)])
        popular = lambda t: F.aggregate(t, F.lit(0.0), lambda acc, k: acc + F.element_at(logs, k + 1))
        d = d.withColumn("popularity", (popular("a") - popular("b")) / 3)
    for more in joined:
        d = d.join(more, "match_id", "left")
    if joined or "popularity" in asked:
        d = durable(d)  # once for both parts
    return d.where(F.col("rn") <= cut), d.where(F.col("rn") > cut)


@query()
def ridge_fit(spark, sf):
    train, _ = _split(spark, sf)
    return fit.fit(train, ["solo"]).coefficients.withColumn("beta", F.round("beta", 4))


CONTEXT = ["solo", "solo_mode", "solo_map"]
LADDER = [
    ("M0", ["solo"]), ("M1", CONTEXT), ("M2", [*CONTEXT, "synergy"]), ("M3", [*CONTEXT, "counter"]), ("M4", [*CONTEXT, "synergy", "counter"]), ("M5", [*CONTEXT, "synergy", "counter", "theory"]),
    ("M6", [*CONTEXT, "synergy", "counter", "theory", "structure"]), ("M8", [*CONTEXT, "synergy", "counter", "power", "mastery"]),
    ("P_mode", ["solo", "solo_mode"]), ("P_map", CONTEXT), ("P_tier", [*CONTEXT, "solo_tier"]),
]


@query()
def ablation_ladder(spark, sf):
    """Each rung's quality on the later matches, how many parameters it has and how many steps its fit took.

    A fit begins with the largest rung before it that its families hold, and for families that one lacks with the next largest.  Rungs that read no more than teams, mode and
    map share the rows of their fits; the later matches are scored by all rungs at once."""
    train, test = _context(spark, sf, list(dict.fromkeys(f for _, families in LADDER for f in families)))
    done, rows = {}, _rungs(train, [families for _, families in LADDER])
    for _, families in LADDER:
        key = tuple(families)
        if key not in done:
            within = sorted((k for k in done if set(k) <= set(key)), key=len, reverse=True)
            done[key] = fit.fit(rows(families), families, start=_begun([done[k] for k in within]))
    scored = durable(fit.predict_all(list(done.values()), test).select("y", *[sigmoid(f"z{k}").alias(f"p{k}") for k in range(len(done))]))  # read by each rung
    out = {key: _quality(scored.select("y", F.col(f"p{k}").alias("p"))) for k, key in enumerate(done)}
    first = lambda name, families: {"rung": name, "families": "+".join(families), "params": len(done[tuple(families)].names), "steps": done[tuple(families)].iterations}
    return _union([out[tuple(families)].select(*[F.lit(v).alias(k) for k, v in first(name, families).items()], "*") for name, families in LADDER])


def _begun(models):
    """The first of the models with the coefficients that it lacks from the ones after it."""
    if not models:
        return None
    found = {name: beta for m in reversed(models) for name, beta in zip(m.names, m.beta.tolist(), strict=True)}
    return fit.Model(models[0].spark, list(found), list(found.values()), models[0].families)


def _rungs(train, rungs):
    """What each rung's fit takes, as a function of its families: rows by teams, mode and map are made once for all that read
    no more, and those by less are made of them."""
    known = {"a", "b", "mode", "map_id", *bind.TRAITS}  # traits follow from the map
    wide = list(dict.fromkeys(f for families in rungs if set(design.reads(families)) <= known for f in families))
    asked = set(design.reads(wide)) - set(bind.TRAITS)
    made = fit.prepare(train, wide)

    def rows(families):
        if not set(families) <= set(wide):
            return fit.prepare(train, families)
        return made.within(families) if asked <= set(design.reads(families)) else fit.prepare(made.cells, families, "w")

    return rows


@query()
def many_parameters(spark, sf):
    """Rung M4 on 40,000 matches, or all there are if fewer, drawn by a hash: one row of how large the fit is and how it ended."""
    d = bind.decided(spark, sf).select("match_id", "mode", "map_id", "a", "b", "y")
    share = 40_000 / max(d.count(), 1)
    some = durable(d.where(F.pmod(F.xxhash64(F.lit(4), "match_id"), F.lit(1 << 30)) / (1 << 30) < share))
    m = fit.fit(some, [*CONTEXT, "synergy", "counter"])
    return spark.createDataFrame([(some.count(), len(m.names), m.iterations, m.gradient)], "matches long, params int, steps int, gradient double")


@query(
    f"""WITH {D}, o AS (SELECT a, b, row_number() OVER (ORDER BY t, match_id) AS rn, count(*) OVER () AS n FROM d WHERE y IS NOT NULL), q AS (SELECT unnest(a) AS i, b FROM o WHERE rn <= floor(n * 0.8)), p AS (SELECT i, unnest(b) AS j FROM q),
e AS (SELECT i, j FROM p UNION SELECT j, i FROM p), s AS (SELECT CAST(i AS INT) AS brawler_id, count(*) AS n_opponents FROM e WHERE i <> j GROUP BY i) SELECT brawler_id, n_opponents, CAST(0 AS DOUBLE) AS row_sum FROM s"""
)
def counter_row_sums(spark, sf):
    """The constrained fit: how many opponents' counters each character has, and their sum, which is 0.

    The fit itself is held against dense solutions in tests/test_convex.py."""
    train, _ = _split(spark, sf)
    m = fit.fit(train, ["solo", "counter"], constrained=True)
    pairs_of = fit.pair_places(m.names, "ctr")
    rows = [(i, j, s * float(m.beta[k])) for k, i, j in pairs_of for i, j, s in ((i, j, 1.0), (j, i, -1.0))]  # parameters, not rows
    both = spark.createDataFrame(rows, "brawler_id int, other int, c double")
    return both.groupBy("brawler_id").agg(F.count(F.lit(1)).alias("n_opponents"), F.abs(F.round(F.sum("c"), 9)).alias("row_sum"))


@query()
def factor_ladder(spark, sf):
    """Rungs of pair effects of rank 4, 8 and 16 beside full strengths: quality, and the gain in log loss over strengths alone with its interval.

    The fits run side by side, since a step of one is a short job; each goes on until its gradient is below the tolerance."""
    train, test = _split(spark, sf)
    cells = durable(fit.alike(train, []))
    scored = fit.fit(cells, ["solo"], weight="w").predict(test).select("match_id", "a", "b", "y", metrics.log_loss("p", "y").alias("base"))
    ranks, passes = (4, 8, 16), []
    with ThreadPoolExecutor(len(ranks)) as pool:
        fitted = list(pool.map(inheritable_thread_target(spark)(lambda k: factors.fit(cells, k, weight="w")), ranks))
    for k, m in zip(ranks, fitted, strict=True):
        scored = m.predict(scored).drop("z").withColumnRenamed("p", f"p{k}")
        passes.append(m.passes)
    scored = durable(scored.withColumns({f"loss{k}": metrics.log_loss(f"p{k}", "y") for k in ranks}))
    gains = resample.paired_differences(scored, "base", [f"loss{k}" for k in ranks], "match_id")
    delta = spark.createDataFrame([(f"k={k}", *g[1:]) for k, g in zip(ranks, gains, strict=False)], "rung string, delta double, low double, high double, matters boolean")
    out = _union([_quality(scored.withColumn("p", F.col(f"p{k}")), rung=f"k={k}", passes=n) for k, n in zip(ranks, passes, strict=True)])
    return out.join(delta.select("rung", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")], "matters"), "rung")


@query()
def temperature_scaling(spark, sf):
    train, test = _split(spark, sf)
    s = durable(fit.fit(train, ["solo", "solo_mode"]).predict(test))
    t = fit.temperature(s)
    cooled = s.withColumn("p", 1 / (1 + F.exp(-F.col("z") / t)))
    return _union([_quality(s, which="raw", temperature=1.0), _quality(cooled, which="scaled", temperature=round(t, 4))])


@query()
def shrinkage_cv(spark, sf):
    """Penalties by block from their loss on the last part of the training time, and what the chosen ones give on the test part."""
    train, test = _split(spark, sf)
    cut = int(train.count() * 0.85)
    inner, check = train.where(F.col("rn") <= cut), train.where(F.col("rn") > cut)
    families = ["solo", "solo_mode"]
    best, _ = fit.search(inner, check, families, families, [5.0, 25.0, 125.0])
    made, asked = fit.prepare(train, families), durable(fit.alike(test, families))
    rows = [_quality(durable(fit.fit(made, families, p).predict(asked)), "w", penalties=name, solo=p["solo"], solo_mode=p["solo_mode"]) for name, p in (("given", {f: fit.PENALTY[f] for f in families}), ("chosen", best))]
    return _union(rows)


@query()
def empirical_bayes(spark, sf):
    """Penalties by evidence beside the given ones, and what each gives on the test part."""
    train, test = _split(spark, sf)
    families = ["solo", "solo_mode"]
    given = {f: fit.PENALTY[f] for f in families}
    m, found, settled = fit.evidence(train, families, families, rounds=8)
    asked = durable(fit.alike(test, families))
    rows = [(name, p, durable(x.predict(asked))) for name, p, x in (("given", given, fit.fit(train, families)), ("evidence", found, m))]
    return _union([_quality(scored, "w", penalties=name, solo=round(p["solo"], 2), solo_mode=round(p["solo_mode"], 2), settled=settled or name == "given") for name, p, scored in rows])


@query()
def ban_counterfactual(spark, sf):
    """What a ban changes for the team that picks first, each draft completed from its first two picks by popularity on its map."""
    d = bind.decided(spark, sf).select("match_id", "map_id", "a", "b", "y", "mode")
    m = factors.fit(d, 4)
    picks = d.select("map_id", F.explode(F.concat("a", "b")).alias("k")).groupBy("map_id", "k").agg(F.count(F.lit(1)).alias("n"))
    popularity = {}
    for r in picks.collect():  # maps times characters
        popularity.setdefault(r["map_id"], np.ones(bind.N))[r["k"]] += r["n"]
    return rollout.ban_values(d, m.solo, *m.tables, popularity).select("map_id", "brawler_id", F.round("value", 6).alias("value"), "n_drafts")


@query()
def half_life_sweep(spark, sf):
    train, test = _split(spark, sf)
    last, asked = train.agg(F.max("t")).first()[0], durable(fit.alike(test, ["solo"]))
    out = []
    for days in (0, 365, 60):
        rows = train.withColumn("w", decay(F.datediff(F.lit(last), F.col("t")), float(days)) if days else F.lit(1.0))
        out.append(_quality(durable(fit.fit(rows, ["solo"], weight="w").predict(asked)), "w", half_life_days=days))
    return _union(out)


@query()
def growing_sweep(spark, sf):
    """Fits as the data grow, each begun with the one before: its steps beside those from nothing, which end in the same model, and its loss on the last part."""
    train, test = _split(spark, sf)
    n, before, out, asked = train.count(), None, [], durable(fit.alike(test, ["solo"]))
    for share in (0.25, 0.5, 0.75, 1.0):
        rows = fit.prepare(train.where(F.col("rn") <= int(n * share)), ["solo"])
        cold, warm = fit.fit(rows, ["solo"]), fit.fit(rows, ["solo"], start=before)
        apart = float(np.abs(cold.beta - warm.beta).max()) if len(cold.beta) else 0.0
        out.append(_quality(durable(warm.predict(asked)), "w", share=share, steps_cold=cold.iterations, steps=warm.iterations, same=apart < 1e-3))
        before = warm
    return _union(out)


@query()
def confound_refit(spark, sf):
    """How far solo coefficients shrink once modes have their own."""
    train, _ = _split(spark, sf)
    plain, more = fit.fit(train, ["solo"]).coefficients, fit.fit(train, ["solo", "solo_mode"]).coefficients
    both = plain.withColumnRenamed("beta", "alone").join(more.withColumnRenamed("beta", "beside"), "feature")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("alone")), 5).alias("alone"), F.round(F.avg(F.abs("beside")), 5).alias("beside"))


def _residuals(spark, sf):
    """A row for each team of a match: who it is, and what fitted strengths leave of its result."""
    d = bind.decided(spark, sf).select("match_id", "mode", "map_id", "a", "b", "y")
    scored = fit.fit(d, ["solo"], {"solo": 25.0}).predict(d)
    expected = F.when(F.col("side") == 0, F.col("p")).otherwise(1 - F.col("p"))
    return comps.with_roles(pairs.sides(scored)).withColumns({"expected": expected, "residual": F.col("won") - expected})


@query()
def comp_fit_residual(spark, sf):
    """Each composition family's mean residual over fitted strengths."""
    return comps.family_residuals(_residuals(spark, sf)).withColumn("mean", F.round("mean", 5))


@query()
def pick_fit_residual(spark, sf):
    """Number, sum and mean of the residuals over fitted strengths for each pair and each triple of allies."""
    label = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("picks"))
    both = F.transform(pairs.same_team("team"), lambda p: label("pair", F.concat_ws(",", p["i"].cast("string"), p["j"].cast("string"))))
    rows = _residuals(spark, sf).select("residual", F.explode(F.concat(both, F.array(label("triple", pairs.triple("team"))))).alias("x"))
    by = pairs.residual_means(rows.select("residual", "x.kind", "x.picks"), ["kind", "picks"], "residual")
    return by.where("kind = 'pair' OR n >= 2").select("kind", "picks", "n", F.round("total", 5).alias("total"), F.round("mean", 5).alias("mean"))


@query()
def seat_fit_residual(spark, sf):
    """How often the first team wins by mode, what fitted strengths expect of it, and what they leave, with its interval."""
    first = _residuals(spark, sf).where("side = 0")
    g = first.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("rate"), F.avg("expected").alias("expected"), F.avg("residual").alias("residual"), F.stddev_samp("residual").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return g.select("mode", "n", *[F.round(c, 5).alias(c) for c in ("rate", "expected", "residual")], F.round(F.col("residual") - half, 5).alias("low"), F.round(F.col("residual") + half, 5).alias("high"))


@query()
def clustered_bootstrap(spark, sf):
    """Means of composition families' residuals over the solo fit, with intervals that
    resample whole matches, and their false discovery rate by the normal p-values,
    which go below 1 / replicates."""
    rows = _residuals(spark, sf)
    each = rows.select("match_id", "residual", F.explode(comps.memberships()).alias("m")).withColumn("grp", F.concat_ws(":", "m.family", "m.label"))
    out = durable(resample.group_means(each, "grp", "residual", "match_id").where("n >= 30 AND p IS NOT NULL"))
    return ranking.false_discovery(out, "p_normal", "grp").select("grp", "n", *[F.round(c, 5).alias(c) for c in ("mean", "error", "low", "high", "p", "p_normal")], "fdr", "bonferroni")


@query()
def split_half(spark, sf):
    """Agreement of ban lists from two halves of the matches, with fitted strengths."""
    d = bind.decided(spark, sf).select("match_id", "mode", "map_id", "a", "b", "y").withColumn("half", F.pmod(F.xxhash64(F.lit(99), "match_id"), F.lit(2)))
    lists = []
    for k in (0, 1):
        part = durable(d.where(F.col("half") == k))
        beta = fit.fit(part, ["solo"]).coefficients
        w = beta.select(F.split("feature", ":")[1].cast("int").alias("brawler_id"), F.col("beta").alias("w"))
        lists.append(durable(decide.ban_list(part, durable(w))))
    return decide.captured(lists[0], lists[1], 5).select("map_id", F.round("captured", 5).alias("captured"))


@query()
def ban_scaling(spark, sf):
    """Would more matches help: agreement of ban lists with strengths by mode and map, fitted anew for each nested sample of either half."""
    d = bind.decided(spark, sf).select("match_id", "mode", "map_id", "a", "b", "y")
    half, draw = F.pmod(F.xxhash64(F.lit(99), "match_id"), F.lit(2)), F.pmod(F.xxhash64(F.lit(7), "match_id"), F.lit(1 << 30)) / (1 << 30)
    sizes, families = [0.25, 0.5, 1.0], ["solo", "solo_mode", "solo_map"]
    cells, samples = _nested(d, families, half, draw, sizes)
    fitted, before = [], {}
    for s in sizes:
        for h in (0, 1):
            m = before[h] = fit.fit(fit.Prepared(samples[s, h], families), families, start=before.get(h))
            fitted.append(decide.map_strengths(m.coefficients, cells, weight="n").select(F.lit(s).alias("size"), F.lit(h).alias("half"), "map_id", "brawler_id", "w"))
    return rounded(decide.agreement(cells, durable(_union(fitted)), sizes, F.col("half"), F.col("draw"), least=20, weight="n"))


def _nested(d, families, half, draw, sizes):
    """Matches that neither the families nor the samples tell apart, made in one pass over them: a row for each half and least
    draw that the same samples hold, with their number n; and by size and half the sample's rows as by ``fit.alike``."""
    keys, lows = design.reads(families), [0.0, *sizes[:-1]]
    rows = d.select(*[c.alias(k) for k, c in keys.items()], "y", half.alias("_half"), draw.alias("_draw")).where(F.col("_draw") < sizes[-1])
    within = {(low, h): (F.col("_half") == h) & (F.col("_draw") >= low) & (F.col("_draw") < s) for low, s in zip(lows, sizes, strict=True) for h in (0, 1)}
    name = {k: i for i, k in enumerate(within)}
    wide = durable(rows.groupBy(*keys).agg(*[f.alias(f"{c}{name[k]}") for k, own in within.items() for c, f in (("n", F.count_if(own)), ("won", F.count_if(own & (F.col("y") == 1))))]))
    each = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(low).alias("draw"), F.col(f"n{i}").alias("n")) for (low, h), i in name.items()])
    samples = {}
    for s in sizes:
        for h in (0, 1):
            w, won = (sum((F.col(f"{c}{name[low, h]}") for low in lows if low < s), F.lit(0)).cast("double") for c in ("n", "won"))
            samples[s, h] = wide.where(w > 0).select(*keys, F.lit(0.0).alias("offset"), w.alias("w"), (won / w).alias("y"))
    return wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("n > 0"), samples


def _planned(spark, sf) -> list[tuple[str, int, float]]:
    """Test, degrees of freedom and variance a match of joint tests, from the spread of the data's own pick rates."""
    picks = bind.drafts(spark, sf).select(F.explode(F.concat("a", "b")).alias("brawler_id"))
    by = picks.groupBy("brawler_id").agg(F.count(F.lit(1)).alias("k"))
    total = by.agg(F.sum("k").alias("total"))
    q = by.crossJoin(F.broadcast(total)).select((F.col("k") / F.col("total")).alias("q"))
    s1, s2, n = q.agg(F.sum(6 * F.col("q")), F.sum(F.col("q") * F.col("q")), F.count(F.lit(1))).first()
    if not n:
        return []
    sigma, many = power.sigma_from_auc(0.56), n * (n - 1) // 2
    solo, pair = sigma**2 * float(s1) / 6, sigma**2 * (1 - float(s2)) / 3
    return [("solo", int(n - 1), solo), ("synergy", int(many), pair), ("counter", int(many), pair), ("both", int(2 * many), 2 * pair)]


@query()
def power_table(spark, sf):
    """Matches that joint tests would need."""
    rows = [(name, df, round(v, 6), power.matches_needed(df, v, 0.05 / 6)) for name, df, v in _planned(spark, sf)]
    return spark.createDataFrame(rows, "test string, df int, variance double, n80 bigint")


@query()
def achieved_power(spark, sf):
    """The power of each joint test at the number of matches to train on."""
    n = int(bind.decided(spark, sf).count() * 0.8)
    rows = [(name, df, n, round(power.power(df, n * v / 4, 0.05 / 6), 4)) for name, df, v in _planned(spark, sf)]
    return spark.createDataFrame(rows, "test string, df int, n_train long, power double")


_NEED = "6e0 * (2.638257273476751e0 + 0.8416212335729144e0) * (2.638257273476751e0 + 0.8416212335729144e0) / (2 * tau * 2 * tau)"


@query(
    f"""WITH {D}, pk AS (SELECT CAST(unnest(list_concat(a, b)) AS INT) AS i FROM d), c AS (SELECT i, count(*) AS k FROM pk GROUP BY i), q AS (SELECT CAST(r.i AS INT) AS i, coalesce(k, 0) / CAST(sum(k) OVER () AS DOUBLE) AS q FROM range(107) r(i) LEFT JOIN c ON c.i = r.i),
pr AS (SELECT 12 * (x.q * y.q) AS synergy, 18 * (x.q * y.q) AS counter FROM q x JOIN q y ON x.i < y.i), u AS (SELECT 'synergy' AS family, synergy AS rate FROM pr UNION ALL SELECT 'counter', counter FROM pr),
o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rate DESC) AS rn, count(*) OVER (PARTITION BY family) AS n FROM u), t(scenario, family, tau) AS (VALUES ('per pair', 'synergy', 0.071462::DOUBLE), ('per pair', 'counter', 0.063917), ('in all', 'synergy', 0.130471), ('in all', 'counter', 0.106528)),
mt AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n_train FROM d WHERE y IS NOT NULL), e AS (SELECT scenario, t.family, tau, count(*) AS n_pairs, count(*) FILTER (WHERE rate * n_train >= {_NEED}) AS n_enough FROM t JOIN u ON t.family = u.family, mt GROUP BY ALL), pl(place) AS (VALUES (0.1::DOUBLE), (0.5), (0.9))
SELECT scenario, e.family, place, round(2 * tau, 6) AS delta, round(rate, 9) AS rate, round({_NEED}, 2) AS occurrences, round(CASE WHEN rate > 0 THEN {_NEED} / rate END, 2) AS matches, round(4 / (tau * tau), 2) AS half, n_enough, n_pairs FROM e JOIN o ON o.family = e.family JOIN pl ON o.rn = least(n - 1, floor(place * n)) + 1"""
)
def coefficient_power(spark, sf):
    """Matches that a single strong synergy or counter would need, for pairs met often, at the median and seldom, in both transfers of published effects."""
    picks = bind.drafts(spark, sf).select(F.explode(F.concat("a", "b").cast("array<int>")).alias("brawler_id"))
    by = picks.groupBy("brawler_id").agg(F.count(F.lit(1)).alias("k"))
    shares = durable(spark.range(bind.N).select(F.col("id").cast("int").alias("brawler_id")).join(by, "brawler_id", "left").crossJoin(F.broadcast(by.agg(F.sum("k").alias("total")))).select("brawler_id", (F.coalesce("k", F.lit(0)) / F.col("total")).alias("q")))
    one = power.terms()
    out = power.pair_sizes(shares, {"per pair": one, "in all": power.transferred(one, total=True)}, int(bind.decided(spark, sf).count() * 0.8), 0.05 / 6, (0.1, 0.5, 0.9))
    return out.select("scenario", "family", "place", F.round("delta", 6).alias("delta"), F.round("rate", 9).alias("rate"), *[F.round(c, 2).alias(c) for c in ("occurrences", "matches", "half")], "n_enough", "n_pairs")


@query()
def transfer_auc(spark, sf):
    """A model of one mode on the others: AUC with its interval."""
    train, test = _split(spark, sf)
    m = train.agg(F.min("mode")).first()[0]
    s = durable(fit.fit(train.where(F.col("mode") == m), ["solo"]).predict(test.where(F.col("mode") != m)))
    modes = [r["mode"] for r in s.select("mode").distinct().orderBy("mode").collect()]  # a handful
    return _union([metrics.auc_interval(s.where(F.col("mode") == x)).select(F.lit(x).alias("mode"), *[F.round(c, 5).alias(c) for c in ("auc", "low", "high")], "n_pos", "n_neg") for x in modes])


#: Signal, whether a draft alone shows it, and its families beside the base.
SIGNALS = [
    ("map", True, ["solo_map"]), ("class matchup", True, ["matchup"]), ("class counts", True, ["roles"]), ("class stack", True, ["stack"]), ("popularity", True, ["popularity"]),
    ("side", False, ["side"]), ("power", False, ["power"]), ("mastery", False, ["mastery"]),
]
INTERACTIONS = [
    ("class matchup by mode", True, ["matchup_mode"]), ("patch", True, ["solo_patch"]), ("synergy", True, ["synergy"]), ("counter", True, ["counter"]), ("synergy and counter", True, ["synergy", "counter"]),
    ("map and class matchup", True, ["solo_map", "matchup"]), ("power and mastery", False, ["power", "mastery"]),
]
TIERS = [("tier", True, ["solo_tier"]), ("counter by mode", True, ["counter_mode"])]


def _sweep(spark, sf, signals):
    """Each signal's gain in log loss over the base, with an interval over resampled matches and the false discovery rate of all.

    Signals that read the same share the rows of their fits; the later matches are scored by all models at once."""
    base_families, cells = ["solo", "solo_mode"], {}
    train, test = _context(spark, sf, [*base_families, *[f for _, _, families in signals for f in families]])

    def rows(families):
        key = frozenset(design.reads(families))
        if key not in cells:
            cells[key] = durable(fit.alike(train, families))
        return fit.Prepared(cells[key], families)

    models = [fit.fit(rows(base_families), base_families)]
    for _, _, families in signals:
        models.append(fit.fit(rows([*base_families, *families]), [*base_families, *families], start=models[0]))
    losses = [metrics.log_loss(sigmoid(f"z{k}"), "y").alias(f"l{k}") for k in range(len(models))]
    scored = durable(fit.predict_all(models, test).select("match_id", *losses))  # read twice
    deltas = resample.paired_differences(scored, "l0", [f"l{k}" for k in range(1, len(models))], "match_id")
    found = [(name, deployable, len(m.names), *x) for (name, deployable, _), m, x in zip(signals, models[1:], deltas, strict=False)]
    out = spark.createDataFrame(found, "signal string, deployable boolean, params int, n long, delta double, low double, high double, matters boolean")
    ranked = ranking.false_discovery(durable(out.withColumn("p", p_of_interval("delta", "low", "high"))), "p", "signal")
    return ranked.select("signal", "deployable", "params", "n", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p")], "matters", "fdr")


@query()
def signal_sweep(spark, sf):
    return _sweep(spark, sf, SIGNALS)


@query()
def interaction_sweep(spark, sf):
    return _sweep(spark, sf, INTERACTIONS)


@query()
def tier_sweep(spark, sf):
    return _sweep(spark, sf, TIERS)


@query()
def hour_sweep(spark, sf):
    """Whether strengths depend on the hour: it tells who plays, not what to pick, so no draft may use it."""
    return _sweep(spark, sf, [("hour of day", False, ["solo_hour"])])


@query()
def tier_correlation(spark, sf):
    """Strengths fitted for each tier by itself, and how two tiers' agree."""
    train, _ = _context(spark, sf, ["solo_tier"])
    cells = durable(fit.alike(train, ["solo_tier"]))
    tiers = [r["tier"] for r in cells.where("tier IS NOT NULL").groupBy("tier").agg(F.sum("w").alias("n")).where("n >= 200").orderBy("tier").collect()]  # four at most
    fits = {t: durable(fit.fit(cells.where(F.col("tier") == t), ["solo"], weight="w").coefficients) for t in tiers}
    out = [spark.createDataFrame([], "tier int, other int, n long, r double")]
    for i, t in enumerate(tiers):
        for u in tiers[i + 1 :]:
            both = fits[t].join(fits[u].withColumnRenamed("beta", "other_beta"), "feature")
            out.append(both.agg(F.lit(t).alias("tier"), F.lit(u).alias("other"), F.count(F.lit(1)).alias("n"), F.round(F.corr("beta", "other_beta"), 4).alias("r")))
    return _union(out)


@query()
def carry_forward(spark, sf):
    """Strengths of the later half fitted as a change from those of the earlier half: the penalty is on the change."""
    early, late = _split(spark, sf, 0.5)
    old = fit.fit(early, ["solo"])
    change = fit.fit(old.predict(late).withColumnRenamed("z", "before"), ["solo"], {"solo": 25.0}, offset="before")
    both = old.coefficients.withColumnRenamed("beta", "old").join(change.coefficients.withColumnRenamed("beta", "change"), "feature", "full")
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("feature", F.round(value("old"), 4).alias("old"), F.round(value("old") + value("change"), 4).alias("new"))


@query()
def lane_second_stage(spark, sf):
    """Features of the lane scores beside a frozen model with counters: their weights and gain in log loss."""
    train, test = _split(spark, sf)
    made = fit.prepare(train, ["solo", "counter"])
    m = fit.fit(made, ["solo", "counter"])
    # Weights need a row for all matches of the same teams only; intervals need each match.
    cells = durable(lanes.with_lanes(m.predict(made.cells), m.coefficients))
    weights = {name: lanes.offset_fit(cells, make(), w="w") for name, make in lanes.FEATURES.items()}
    scored = lanes.with_lanes(m.predict(test), m.coefficients)
    losses = [metrics.log_loss(lanes.chance(lanes.FEATURES[name](), w), "y").alias(f"l{k}") for k, (name, w) in enumerate(weights.items())]
    scored = durable(scored.select("match_id", metrics.log_loss("p", "y").alias("base"), *losses))
    deltas = resample.paired_differences(scored, "base", [f"l{k}" for k in range(len(weights))], "match_id")
    rows = [(name, [round(x, 4) for x in w], *d) for (name, w), d in zip(weights.items(), deltas, strict=False)]
    out = spark.createDataFrame(rows, "feature string, weights array<double>, n long, delta double, low double, high double, matters boolean")
    return out.select("feature", "weights", "n", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")], "matters")
