"""Rows of a fit made once for many penalties, steps scaled by whole blocks, and models compared in one pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.functions.expr import sigmoid
from trifold.operators import convex, design, factors, fit, lanes, metrics, resample, simulate
from trifold.plans import models
from trifold.session import durable


@pytest.fixture
def grouped(monkeypatch):
    """Families of each call that groups matches."""
    calls, alike = [], fit.alike
    monkeypatch.setattr(fit, "alike", lambda drafts, families, *more: calls.append(list(families)) or alike(drafts, families, *more))
    return calls


def _drafts(spark, n=1500, modes=2):
    return durable(simulate.drafts(spark, n, n=12, spread=0.5).withColumns({"mode": F.concat(F.lit("m:"), F.col("match_id") % modes), "map_id": (F.col("match_id") % 3).cast("int")}))


def test_penalties_share_rows(spark, grouped):
    """A search groups its two parts once, evidence its one."""
    d = _drafts(spark)
    fit.search(d.where("match_id % 4 > 0"), d.where("match_id % 4 = 0"), ["solo"], ["solo"], [0.5, 500.0])
    assert len(grouped) == 2
    m, penalty, _ = fit.evidence(d, ["solo"], ["solo"], rounds=3)
    assert len(grouped) == 3
    again = fit.fit(d, ["solo"], penalty)
    assert again.names == m.names and again.beta == pytest.approx(m.beta, abs=1e-3)


def test_blocks_scale_steps(spark, monkeypatch):
    """Classes follow from the characters: with the blocks' own matrix the fit takes a third of a diagonal's steps, and ends in the same place."""
    made = fit.prepare(_drafts(spark), ["solo", "solo_mode", "matchup"])
    m = fit.fit(made, made.families)
    monkeypatch.setattr(fit, "DENSE", 0)
    plain = fit.fit(made, made.families)
    assert 3 * m.iterations < plain.iterations and m.beta == pytest.approx(plain.beta, abs=2e-3)
    beta, chosen = np.random.default_rng(1).normal(0, 0.2, len(made.names)), np.array([0, 2, 5, len(made.names) - 1])
    x, w = np.zeros((made.cells.count(), len(beta))), []
    for i, r in enumerate(made.data.collect()):
        x[i, r["number"]] = r["value"]
        w.append(r["w"])
    p = 1 / (1 + np.exp(-x @ beta))
    want = (x.T * (np.array(w) * p * (1 - p))) @ x
    whole = want + np.eye(len(want))
    assert fit._inverse(whole) == pytest.approx(np.linalg.inv(whole))
    monkeypatch.setattr(convex, "PAIRED", 100)
    assert convex.logistic_block(made.data, beta, chosen) == pytest.approx(want[np.ix_(chosen, chosen)])


def test_all_models_at_once(spark):
    d = _drafts(spark)
    two = [fit.fit(d, ["solo", "solo_mode"]), fit.fit(d.where("match_id % 2 = 0"), ["solo", "counter"])]
    got = fit.predict_all(two, d)
    for k, m in enumerate(two):
        assert m.predict(d).select("match_id", "z").join(got, "match_id").where(F.abs(F.col("z") - F.col(f"z{k}")) > 1e-12).count() == 0


def test_differences_share_weights(spark):
    """Several columns at once are what each gives by itself, and what plain replicates give."""
    rng = np.random.default_rng(4)
    rows = [(k // 2, *map(float, rng.normal([0.3, 0.25, 0.31], 0.2))) for k in range(3000)]
    d = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(3)
    got = resample.paired_differences(d, "a", ["b", "c"], "k")
    for column, x in zip("bc", got, strict=True):
        assert x == pytest.approx(tuple(resample.paired_difference(d, "a", column, "k").first()))
    each = d.select(F.xxhash64("k").alias("h"), F.col("a") - F.col("b")).collect()
    w, v = resample._weights(np.array([r[0] for r in each]), 400, 99), np.array([r[1] for r in each])
    means = np.sort((w.T.astype(float) @ v) / w.sum(axis=0))
    assert got[0][1] == pytest.approx(v.mean()) and {round(got[0][2], 9), round(got[0][3], 9)} <= {round(float(x), 9) for x in means}
    assert resample.paired_differences(d.limit(0), "a", ["b", "c"], "k") == []


def test_quality_of_grouped_rows(spark):
    """Loss, square loss, number and AUC over rows that stand for several are those over all of them."""
    d = _drafts(spark, 600)
    d = durable(d.unionByName(d.withColumn("y", 1 - F.col("y"))).unionByName(d))
    m = fit.fit(d, ["solo"])
    one, many = m.predict(d), durable(m.predict(fit.alike(d, ["solo"])))
    assert many.count() < d.count()
    # Sums in another order may part equal chances by a rounding.
    assert tuple(metrics.losses(many, w="w").first()) == pytest.approx(tuple(metrics.losses(one).first()))
    assert metrics.auc(many, w="w").first()["auc"] == pytest.approx(metrics.auc(one).first()["auc"], abs=1e-3)
    assert tuple(metrics.auc(many, w="w").first())[1:] == tuple(metrics.auc(one).first())[1:]


def test_weighted_second_stage_and_factors(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(z), int(y), int(w)) for x, z, y, w in zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 2, 300), rng.integers(1, 4, 300), strict=True)]
    d = spark.createDataFrame(rows, "x double, z double, y int, w int")
    long = d.withColumn("_", F.explode(F.sequence(F.lit(1), "w"))).drop("w")
    assert lanes.offset_fit(d, [F.col("x")], w="w") == pytest.approx(lanes.offset_fit(long, [F.col("x")]))
    d = _drafts(spark, 400)
    one, two = factors.fit(d, 2, n_ids=12, rounds=1), factors.fit(durable(fit.alike(d, [])), 2, n_ids=12, rounds=1, weight="w")
    assert one.solo == pytest.approx(two.solo, abs=1e-6) and one.u == pytest.approx(two.u, abs=1e-6)


def test_a_sweep_groups_what_differs(spark, sf, grouped):
    """Signals that read the same take one grouping, and the lines only what a signal reads."""
    signals = [("matchup", True, ["matchup"]), ("stack", True, ["stack"]), ("side", False, ["side"]), ("hour", False, ["solo_hour"])]
    rows = {r["signal"]: r for r in models._sweep(spark, sf, signals).collect()}
    assert len(rows) == 4 and len(grouped) == 2
    train, test = models._context(spark, sf)
    loss = lambda m: m.predict(test).agg(F.avg(metrics.log_loss(sigmoid("z"), "y"))).first()[0]
    base = ["solo", "solo_mode"]
    want = loss(fit.fit(train, base)) - loss(fit.fit(train, [*base, "solo_hour"]))
    assert rows["hour"]["delta"] == pytest.approx(want, abs=5e-6) and rows["hour"]["n"] == test.count()
    assert {"power", "tier"}.isdisjoint(models._context(spark, sf, base)[0].columns) and set(design.reads(base)) <= set(train.columns)
