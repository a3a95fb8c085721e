"""The optimiser against dense solutions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.functions.expr import pair_index
from trifold.operators import convex, design, fit, simulate
from trifold.sources.bind import N


def dense(drafts, families, names):
    """Design matrix and labels of a few drafts."""
    rows = design.rows(drafts, families).collect()
    ids = sorted(r["match_id"] for r in drafts.select("match_id").collect())
    x = np.zeros((len(ids), len(names)))
    for r in rows:
        x[ids.index(r["match_id"]), names.index(r["feature"])] += r["value"]
    y = {r["match_id"]: r["y"] for r in drafts.collect()}
    return x, np.array([y[k] for k in ids], float)


def newton(x, y, penalty, matrix):
    """Exact minimiser under matrix @ beta = 0, by Newton steps on the conditions of optimality."""
    beta, m = np.zeros(x.shape[1]), len(matrix)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (p - y) + penalty * beta
        h = (x.T * (p * (1 - p))) @ x + np.diag(penalty)
        kkt = np.block([[h, matrix.T], [matrix, np.zeros((m, m))]])
        beta = beta + np.linalg.lstsq(kkt, np.append(-g, np.zeros(m)), rcond=None)[0][: len(beta)]
    return beta


def few(spark, n=250, ids=9):
    rng = np.random.default_rng(4)
    rows = [(k, rng.choice(ids, 3, replace=False).tolist(), rng.choice(ids, 3, replace=False).tolist(), int(rng.random() < 0.6), "m", 1) for k in range(n)]
    return spark.createDataFrame(rows, "match_id long, a array<int>, b array<int>, y int, mode string, map_id int")


def test_constrained_fit_equals_dense_solution(spark):
    d = few(spark).repartition(5)
    families, penalty = ["solo", "synergy", "counter"], {"solo": 1.0, "syn": 0.5, "ctr": 2.0}
    m = fit.fit(d, families, penalty, constrained=True)
    x, y = dense(d, families, m.names)
    matrix = fit.row_sums(m.names)
    want = newton(x, y, np.array([penalty[f.split(":")[0]] for f in m.names]), matrix)
    assert m.beta == pytest.approx(want, abs=2e-4)
    assert np.abs(matrix @ m.beta).max() < 1e-9 and len(matrix) == 18
    free = fit.fit(d, families, penalty)
    assert free.beta == pytest.approx(newton(x, y, np.array([penalty[f.split(":")[0]] for f in m.names]), np.zeros((0, len(m.names)))), abs=2e-4)
    assert np.abs(matrix @ free.beta).max() > 1e-3


def test_row_sums_name_the_right_pairs(spark):
    pairs = [(0, 1), (0, 106), (1, 2), (5, 9), (50, 106), (105, 106)]
    at = [r[0] for r in spark.createDataFrame(pairs, "i int, j int").select(pair_index(F.col("i"), F.col("j"), N)).collect()]
    names = [f"ctr:{k}" for k in at] + ["solo:3"] + [f"syn:{k}" for k in at]
    assert [(i, j) for _, i, j in fit.pair_places(names, "ctr")] == pairs
    m = fit.row_sums(names)
    assert m.shape == (2 * len({x for p in pairs for x in p}), len(names)) and not m[:, 6].any()
    assert sorted(map(tuple, m[:, 0][m[:, 0] != 0].reshape(1, -1))) == [(1.0, -1.0)]


def test_warm_start_takes_fewer_steps(spark):
    d = simulate.drafts(spark, 3000)
    m = fit.fit(d.where("match_id % 10 < 8"), ["solo"])
    cold, warm = fit.fit(d, ["solo"]), fit.fit(d, ["solo"], start=m)
    assert warm.iterations < cold.iterations and warm.beta == pytest.approx(cold.beta, abs=1e-3)


def test_minimise():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    h, b = a @ a.T + np.eye(30), rng.normal(size=30)
    quadratic = lambda x: (x @ h @ x / 2 - b @ x, h @ x - b)
    found = convex.minimise(quadratic, np.zeros(30), 1e-9)
    assert found.converged and found.x == pytest.approx(np.linalg.solve(h, b), abs=1e-7)
    ones = convex.Constraints(np.ones((1, 30)))
    found = convex.minimise(quadratic, rng.normal(size=30), 1e-9, ones)
    kkt = np.block([[h, np.ones((30, 1))], [np.ones((1, 30)), np.zeros((1, 1))]])
    assert found.converged and found.x == pytest.approx(np.linalg.solve(kkt, np.append(b, 0))[:30], abs=1e-7) and abs(found.x.sum()) < 1e-12
    valley = lambda x: (100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert convex.minimise(valley, np.array([-1.2, 1.0]), 1e-8).x == pytest.approx([1, 1], abs=1e-6)
    assert not convex.minimise(valley, np.array([-1.2, 1.0]), 1e-8, most=3).converged


def test_sums_of_many_parts(spark, monkeypatch):
    """The tree gives the sum whatever the number of parts, empty ones too."""
    monkeypatch.setattr(convex, "FAN", 3)
    rows = spark.range(100).select(F.col("id").cast("double").alias("v"))
    for parts in (1, 3, 4, 28, 120):
        got = convex.sums(rows.repartition(parts), 2, lambda b: np.array([b.num_rows, b.column("v").to_numpy().sum()]))
        assert got.tolist() == [100, 4950]


def test_evidence_equals_dense_iteration(spark):
    d = few(spark, n=600, ids=12).withColumn("b", F.transform("b", lambda x: x + 12))  # no character on both sides
    m, penalty, settled = fit.evidence(d, ["solo"], ["solo"])
    x, y = dense(d, ["solo"], m.names)
    spread, none = 0.3, np.zeros((0, len(m.names)))
    for _ in range(60):
        beta = newton(x, y, np.full(len(m.names), 1 / spread**2), none)
        p = 1 / (1 + np.exp(-x @ beta))
        h = (p * (1 - p)) @ x**2
        spread = min(2.0, max(1e-3, np.sqrt((beta**2).sum() / (h / (h + 1 / spread**2)).sum())))
    assert settled and penalty["solo"] == pytest.approx(1 / spread**2, rel=0.05)
    assert m.beta == pytest.approx(newton(x, y, np.full(len(m.names), penalty["solo"]), none), abs=1e-3)
