"""The penalised fitter against an exact solution, and recovery of planted strengths."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import decide, design, fit, lanes, metrics, power, simulate
from trifold.session import durable


def test_exact_solution_and_recovery(spark):
    d = durable(simulate.drafts(spark, 3000, n=20, spread=0.5))
    model = fit.fit(d, ["solo"])
    beta = {r["feature"]: r["beta"] for r in model.coefficients.collect()}
    names = sorted(beta)
    rows = design.rows(d, ["solo"]).collect()
    ids = {m: k for k, m in enumerate(sorted(r["match_id"] for r in d.collect()))}
    x = np.zeros((len(ids), len(names)))
    for r in rows:
        x[ids[r["match_id"]], names.index(r["feature"])] = r["value"]
    y = np.zeros(len(ids))
    for r in d.collect():
        y[ids[r["match_id"]]] = r["y"]
    b = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 5 * np.eye(len(names)), x.T @ (p - y) + 5 * b)
    assert np.abs(b - np.array([beta[n] for n in names])).max() < 1e-4
    truth = {f"solo:{r['brawler_id']}": r["w"] for r in simulate.truth(spark, 20, 0.5).collect()}
    assert np.corrcoef([truth[n] for n in names], b)[0, 1] > 0.9
    swapped = d.select("match_id", F.col("b").alias("a"), F.col("a").alias("b"), "y", "mode", "map_id")
    one, two = model.predict(d), model.predict(swapped).select("match_id", F.col("z").alias("other"))
    assert one.join(two, "match_id").where(F.abs(F.col("z") + F.col("other")) > 1e-9).count() == 0
    assert 0.5 < fit.temperature(one) < 2


def _newton(x, y, penalty, z=0.0):
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z - x @ b))
        b -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(len(b)), x.T @ (p - y) + penalty * b)
    return b


def _matrix(d, names):
    rows = d.orderBy("match_id").collect()
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for team, sign in (("a", 1), ("b", -1)):
            for k in r[team]:
                x[i, names.index(f"solo:{k}")] += sign
    return x, np.array([r["y"] for r in rows]), rows


def test_offset_and_side(spark):
    """The change from earlier strengths under a penalty on the change, and an intercept, against exact solutions."""
    d = durable(simulate.drafts(spark, 2000, n=12, spread=0.5)).withColumn("before", F.sin(F.col("match_id").cast("double")) + 0.2)
    m = fit.fit(d, ["solo"], {"solo": 25.0}, offset="before")
    x, y, rows = _matrix(d, m.names)
    assert np.abs(_newton(x, y, 25.0, np.array([r["before"] for r in rows])) - m.beta).max() < 1e-4 and m.gradient < 1e-5
    biased = d.withColumn("y", F.when(F.col("match_id") % 3 == 0, 1).otherwise(F.col("y")))
    side = fit.fit(biased, ["solo", "side"])
    x, y, _ = _matrix(biased, [f for f in side.names if f != fit.SIDE])
    z = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-z @ side.beta))
    grad = z.T @ (p - y) + np.append(5.0 * side.beta[:-1], 0)
    assert side.names[-1] == fit.SIDE and np.abs(grad).max() < 0.05
    got = side.predict(biased).orderBy("match_id").collect()
    assert np.abs(np.array([r["p"] for r in got]) - p).max() < 1e-9


def test_unfinished_fits_are_told(spark):
    d = durable(simulate.drafts(spark, 800, n=12, spread=0.5))
    with pytest.raises(RuntimeError, match="gradient"):
        fit.fit(d, ["solo"], iterations=1)


def test_penalty_search(spark):
    d = durable(simulate.drafts(spark, 1500, n=12, spread=0.5).withColumn("part", F.col("match_id") % 4))
    train, check = d.where("part > 0"), d.where("part = 0")
    best, tried = fit.search(train, check, ["solo"], ["solo"], [0.5, 500.0])
    losses = {v: metrics.losses(fit.fit(train, ["solo"], {"solo": v}).predict(check)).first()["log_loss"] for v in (0.5, 500.0)}
    assert best == {"solo": min(losses, key=losses.get)} and {(v, round(x, 9)) for _, _, v, x in tried} == {(v, round(x, 9)) for v, x in losses.items()}


def test_auc_interval(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400) * 0.7 + 0.2 * y, 2)  # with ties
    got = metrics.auc_interval(spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")).first()
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    error = np.sqrt(wins.mean(axis=1).var(ddof=1) / len(pos) + wins.mean(axis=0).var(ddof=1) / len(neg))
    assert got["auc"] == pytest.approx(wins.mean()) and got["low"] == pytest.approx(wins.mean() - 1.96 * error) and got["high"] == pytest.approx(wins.mean() + 1.96 * error)


def test_permuted_labels_teach_nothing(spark):
    d = simulate.drafts(spark, 1500, n=20).withColumn("y", F.pmod(F.xxhash64("match_id"), F.lit(2)).cast("int"))
    scored = fit.fit(durable(d), ["solo"]).predict(d)
    assert scored.agg(F.avg(F.abs("z"))).first()[0] < 0.3


def test_lanes_and_second_stage(spark):
    d = spark.createDataFrame([(1, [0, 1, 2], [3, 4, 0], 1), (2, [5, 1, 2], [3, 4, 6], 0)], "match_id long, a array<int>, b array<int>, y int")
    c = {(i, j): (i * 7 + j * 3) % 5 - 2.0 for i in range(8) for j in range(i + 1, 8)}
    pairs = spark.createDataFrame([(i, j, w) for (i, j), w in c.items()], "i int, j int, beta double")
    pairs = pairs.select(F.concat(F.lit("ctr:"), lanes.pair_index(F.col("i"), F.col("j"), 8).cast("string")).alias("feature"), "beta")
    w = lambda i, j: 0.0 if i == j else c[i, j] if i < j else -c[j, i]
    for r in lanes.with_lanes(d, pairs, 8).collect():
        assert r["lane_a"] == [sum(w(i, j) for j in r["b"]) for i in r["a"]]
        assert r["lane_b"] == [sum(w(j, i) for i in r["a"]) for j in r["b"]]
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=4000), rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z - 0.7 * x))).astype(int)
    scored = spark.createDataFrame(list(zip(x.tolist(), z.tolist(), y.tolist(), strict=True)), "x double, z double, y int")
    (found,) = lanes.offset_fit(scored, [F.col("x")])
    p = 1 / (1 + np.exp(-z - found * x))
    assert abs(((p - y) * x).sum() + found) < 1e-4 and abs(found - 0.7) < 0.15


def test_ban_stability_and_power(spark):
    rows = [(k, 1, [0, 1, 2], [3, 4, 5]) for k in range(200)] + [(900, 2, [0, 1, 2], [3, 4, 6])]
    d = spark.createDataFrame(rows, "match_id long, map_id int, a array<int>, b array<int>")
    w = spark.createDataFrame([(k, float(k)) for k in range(7)], "brawler_id int, w double")
    got = {r["map_id"]: (r["mean_share"], r["least_share"]) for r in decide.ban_stability(d, w, k=3).collect()}
    assert got[1] == (1.0, 1.0) and got.get(2, (1.0, 1.0)) == (1.0, 1.0)
    n = power.matches_needed(106, 0.10184, 0.05 / 6)
    assert abs(power.power(106, n * 0.10184 / 4, 0.05 / 6) - 0.8) < 1e-3


def test_sizes_of_terms():
    rng = np.random.default_rng(0)
    one = power.terms()
    z = rng.normal(0, power.sigma_from_accuracy(0.58), 400_000)
    y = rng.random(len(z)) < 1 / (1 + np.exp(-z))
    assert ((z > 0) == y).mean() == pytest.approx(0.58, abs=0.003)
    z = rng.normal(0, power.sigma_from_auc(0.66), 400_000)
    y = rng.random(len(z)) < 1 / (1 + np.exp(-z))
    place = z.argsort().argsort()
    assert (place[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum()) == pytest.approx(0.66, abs=0.003)
    whole = power.transferred(one, total=True)
    for f, a, b in zip(power.Terms._fields, power.FIVE, power.THREE, strict=True):
        assert getattr(whole, f) ** 2 * b == pytest.approx(getattr(one, f) ** 2 * a, rel=1e-4)
    assert power.transferred(one) == one
    # The power of a two-sided test at n occurrences, by simulation of its estimate.
    n = power.coefficient_n(0.2, 0.05, 0.8, 1.0)
    drawn = rng.normal(0.2, 2 / math.sqrt(n), 400_000)
    assert (np.abs(drawn) > 1.959964 * 2 / math.sqrt(n)).mean() == pytest.approx(0.8, abs=0.005)


def test_pair_sizes(spark):
    q = [0.4, 0.3, 0.2, 0.1, 0.0]
    shares = spark.createDataFrame([(10 * k, x) for k, x in enumerate(q)], "brawler_id int, q double")
    rates = {(r["i"], r["j"]): (r["synergy"], r["counter"]) for r in power.pair_rates(shares).collect()}
    assert set(rates) == {(10 * i, 10 * j) for i in range(5) for j in range(i + 1, 5)}
    assert rates[0, 20] == pytest.approx((12 * 0.08, 18 * 0.08))
    t = power.Terms(0.1, 0.2, 0.3)
    got = {(r["family"], r["place"]): r for r in power.pair_sizes(shares, {"x": t}, 1000, 0.05, (0.0, 0.5, 0.99)).collect()}
    need = power.coefficient_n(0.4, 0.05)
    order = sorted((x for x, _ in rates.values()), reverse=True)
    for place, k in ((0.0, 0), (0.5, 5), (0.99, 9)):
        r = got["synergy", place]
        assert r["rate"] == pytest.approx(order[k]) and r["matches"] == (pytest.approx(need / order[k]) if order[k] else None)
        assert r["n_pairs"] == 10 and r["n_enough"] == sum(x * 1000 >= need for x in order)
    assert power.pair_sizes(shares.limit(0), {"x": t}, 1000, 0.05).count() == 0
