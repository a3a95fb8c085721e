"""Factor fits go on until they have settled, in the operator and in the queries that use it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import factors, simulate
from trifold.plans import models
from trifold.session import durable


@pytest.fixture(scope="module")
def drafts(spark):
    return durable(simulate.drafts(spark, 700, n=9, spread=0.8))


def _gradient(d, m):
    """The mean objective's gradient at a model, by differences of a plain objective."""
    rows = d.select(*[F.col(c).cast("array<int>") for c in ("a", "b")], "y").collect()
    a, b, y = (np.array([r[c] for r in rows]) for c in ("a", "b", "y"))

    def value(solo, u, s, c):
        z = factors.scores(solo, u @ s @ u.T, u @ c @ u.T, a, b)
        squares = factors.SOLO * (solo**2).sum() + factors.FACTOR * (u**2).sum() + factors.FORM * ((s**2).sum() + (c**2).sum())
        return ((np.logaddexp(0, z) - y * z).sum() + squares / 2) / len(y)

    own, out = [m.solo, m.u, m.s, m.c], []
    for k, part in enumerate(own):
        for at in np.ndindex(part.shape):
            moved = np.zeros(part.shape)
            moved[at] = 1e-4
            moved = (lambda x: x, lambda x: x, factors.symmetric, factors.antisymmetric)[k](moved)
            up, down = ([x + sign * moved if i == k else x for i, x in enumerate(own)] for sign in (1, -1))
            out.append((value(*up) - value(*down)) / 2e-4)
    return np.abs(out).max()


def test_a_fit_ends_where_its_gradient_does(drafts, monkeypatch):
    whole, short = factors.fit(drafts, 3, n_ids=9), factors.fit(drafts, 3, n_ids=9, rounds=1)
    assert _gradient(drafts, whole) < 1e-6 < 1e-5 < _gradient(drafts, short)
    assert whole.value < short.value and short.passes < whole.passes
    monkeypatch.setattr(factors, "GUARD", 3)
    with pytest.raises(RuntimeError, match="rank 3 stopped after 3 steps"):
        factors.fit(drafts, 3, n_ids=9)


def test_queries_ask_for_whole_fits(spark, sf, monkeypatch):
    """No query stops a fit early. (Here they are, so that the test is short.)"""
    asked, fitted = [], factors.fit

    def fit(d, k, *more, **by):
        asked.append((k, more, set(by) - {"weight"}))
        return fitted(d, k, rounds=1, weight=by.get("weight"))

    monkeypatch.setattr(models.factors, "fit", fit)
    rows = models.factor_ladder(spark, sf).collect()
    assert sorted(r["rung"] for r in rows) == ["k=16", "k=4", "k=8"]
    assert models.ban_counterfactual(spark, sf).count() > 0
    assert sorted(asked, key=lambda x: x[0]) == [(4, (), set()), (4, (), set()), (8, (), set()), (16, (), set())]
