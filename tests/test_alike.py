"""Matches that the families cannot tell apart are one row of a fit, and steps scaled by curvature end in the same place."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import convex, design, factors, fit
from trifold.session import durable


def _repeated(spark, copies=40):
    """Twelve drafts, each played ``copies`` times with picks in another order; the result differs by copy."""
    rng = np.random.default_rng(6)
    kinds = [(rng.choice(7, 3, replace=False).tolist(), rng.choice(7, 3, replace=False).tolist(), f"m:{k % 2}") for k in range(12)]
    rows = [(k * copies + c, rng.permutation(a).tolist(), rng.permutation(b).tolist(), mode, int(rng.random() < 0.3 + 0.03 * k), 0.5 + c % 3) for k, (a, b, mode) in enumerate(kinds) for c in range(copies)]
    return durable(spark.createDataFrame(rows, "match_id long, a array<int>, b array<int>, mode string, y int, w double"))


def test_a_fit_takes_different_matches_only(spark, monkeypatch):
    d, seen, spread = _repeated(spark), [], convex.spread
    monkeypatch.setattr(convex, "spread", lambda rows, n, part: seen.append(n) or spread(rows, n, part))
    m = fit.fit(d, ["solo", "solo_mode"], weight="w")
    factors.fit(d, 2, n_ids=7, rounds=1)
    assert seen == [12, 12]
    rows = d.collect()
    x = np.zeros((len(rows), len(m.names)))
    for i, r in enumerate(rows):
        for team, sign in ((r["a"], 1), (r["b"], -1)):
            for k in team:
                x[i, m.names.index(f"solo:{k}")] += sign
                x[i, m.names.index(f"solo_mode:{r['mode']}:{k}")] += sign
    y, w = np.array([r["y"] for r in rows]), np.array([r["w"] for r in rows])
    p = 1 / (1 + np.exp(-x @ m.beta))
    penalty = np.array([fit.PENALTY[f.split(":")[0]] for f in m.names])
    assert np.abs(x.T @ (w * (p - y)) + penalty * m.beta).max() < 1e-3


def test_alike_keeps_sums(spark):
    d = _repeated(spark).withColumn("before", F.when(F.col("match_id") % 2 == 0, 0.5).otherwise(-0.25))
    got = fit.alike(d, ["solo"], "w", "before")
    assert got.count() == 24 and got.columns == ["a", "b", "offset", "w", "y"]
    total, won, shift = got.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("offset"))).first()
    want = d.agg(F.sum("w"), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("before"))).first()
    assert (total, won, shift) == pytest.approx(tuple(want))
    assert fit.alike(d.withColumn("w", F.lit(0.0)), ["solo"], "w").where("y <> 0 OR y IS NULL").count() == 0


def test_all_families_say_what_they_read(spark):
    """Each family's entries can be made from what it says it reads, and are the same."""
    d = _repeated(spark, 2).withColumns({"map_id": F.col("match_id") % 3, "patch": F.lit("p"), "tier": F.when(F.col("match_id") % 3 > 0, F.col("match_id") % 3), "hour": F.col("match_id") % 24} | {c: F.col("match_id") % 7 - 3.5 for c in ("open", "cover", "power", "mastery", "popularity")})
    for name in design.FAMILIES:
        kept = d.select("match_id", *[c.alias(k) for k, c in design.reads([name]).items()])
        one, two = design.rows(d, [name]), design.rows(kept, [name]).withColumnRenamed("value", "other")
        assert one.join(two, ["match_id", "feature"], "full").where("NOT value <=> other").count() == 0, name


def test_curvature_saves_steps():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40)) / 12
    size = 10.0 ** rng.uniform(-3, 3, 40)
    h, b = size[:, None] ** 0.5 * (a @ a.T + np.eye(40)) * size**0.5, rng.normal(size=40)
    quadratic = lambda x: (x @ h @ x / 2 - b @ x, h @ x - b)
    ones = convex.Constraints(np.ones((1, 40)))
    kkt = np.block([[h, np.ones((40, 1))], [np.ones((1, 40)), np.zeros((1, 1))]])
    for constraints, want in ((None, np.linalg.solve(h, b)), (ones, np.linalg.solve(kkt, np.append(b, 0))[:40])):
        plain = convex.minimise(quadratic, np.zeros(40), 1e-6, constraints)
        found = convex.minimise(quadratic, np.zeros(40), 1e-6, constraints, curvature=np.diag(h).copy())
        assert found.converged and found.x == pytest.approx(want, abs=1e-3, rel=1e-3)
        assert found.evaluations < plain.evaluations


def test_rungs_begin_with_smaller_ones(spark, sf, monkeypatch):
    """Each rung but the first starts from the largest one whose families it holds."""
    from trifold.plans import models

    starts, fitted = {}, fit.fit
    monkeypatch.setattr(models, "LADDER", [("M0", ["solo"]), ("M1", ["solo", "solo_mode"]), ("M5", ["solo", "solo_mode", "theory"])])
    monkeypatch.setattr(models.fit, "fit", lambda train, families, start=None: starts.update({len(families): start and len(start.families)}) or fitted(train, families, start=start))
    assert models.ablation_ladder(spark, sf).count() == 3
    assert starts == {1: None, 2: 1, 3: 2}
