"""The factor fit on drafts of a planted model, and its gradient."""

from __future__ import annotations

import numpy as np
import pytest

from trifold.operators import factors, metrics


def planted(n=20, k=4, rows=30_000, seed=3):
    rng = np.random.default_rng(seed)
    u, s, c = rng.normal(0, 0.8, (n, k)), factors.symmetric(rng.normal(0, 0.5, (k, k))), factors.antisymmetric(rng.normal(0, 0.8, (k, k)))
    true = factors.Factors(rng.normal(0, 0.3, n), u, s, c)
    picks = np.argsort(rng.random((rows, n)), axis=1)[:, :6]
    a, b = picks[:, :3], picks[:, 3:]
    y = (rng.random(rows) < 1 / (1 + np.exp(-factors.scores(true.solo, *true.tables, a, b)))).astype(int)
    return true, a, b, y


@pytest.fixture(scope="module")
def case(spark):
    true, a, b, y = planted()
    import pandas as pd

    frame = pd.DataFrame({"match_id": range(len(y)), "a": a.tolist(), "b": b.tolist(), "y": y})
    return true, spark.createDataFrame(frame, "match_id long, a array<int>, b array<int>, y int").repartition(4)


def test_recovers_a_planted_model(spark, case):
    true, d = case
    found = factors.fit(d.where("match_id % 10 < 8"), 4, n_ids=20)
    off = ~np.eye(20, dtype=bool)
    for got, want in zip(found.tables, true.tables, strict=True):
        assert np.corrcoef(got[off], want[off])[0, 1] > 0.9
    assert (found.s == found.s.T).all() and (found.c == -found.c.T).all()
    test = d.where("match_id % 10 >= 8")
    loss = lambda m: metrics.losses(m.predict(test)).first()["log_loss"]
    none = factors.Factors(found.solo, found.u * 0, found.s, found.c)
    assert loss(found) < loss(true) + 0.01 < loss(none)
    swapped = test.selectExpr("match_id", "b AS a", "a AS b", "y")
    both = found.predict(test).select("match_id", "z").join(found.predict(swapped).selectExpr("match_id", "z AS other"), "match_id")
    assert both.where("abs(z + other) > 1e-9").count() == 0


def test_gradient_by_differences(spark):
    _, a, b, y = planted(n=6, k=2, rows=50)
    d = spark.createDataFrame([(x.tolist(), z.tolist(), int(v)) for x, z, v in zip(a, b, y, strict=True)], "a array<int>, b array<int>, y int")
    losses = factors._losses(d, 6)
    rng = np.random.default_rng(0)
    at = [rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, 6))]
    got = losses(*at)
    for part, index in ((0, (2,)), (1, (1, 4)), (2, (5, 0))):
        up, down = ([x.copy() for x in at] for _ in range(2))
        up[part][index] += 1e-5
        down[part][index] -= 1e-5
        assert got[part + 1][index] == pytest.approx((losses(*up)[0] - losses(*down)[0]) / 2e-5, abs=1e-5)


def test_too_many_characters(spark):
    with pytest.raises(ValueError, match="at most"):
        factors.fit(spark.createDataFrame([], "y int, a array<int>, b array<int>"), 2, n_ids=5000)
