"""Chances of last picks against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest

from trifold.operators import decide

N = 30
SCHEMA = "match_id long, mode string, a array<int>, b array<int>"


def strengths(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, k, float(rng.normal()), k % 5 != 0) for c in ("x", "y") for k in range(N)]
    return {(c, k): (w, s) for c, k, w, s in rows}, spark.createDataFrame(rows, "mode string, brawler_id int, w double, served boolean")


def plain(w, mode, a, b):
    others = {*a[:2], *b}
    z = sum(w[mode, k][0] for k in a[:2]) - sum(w[mode, k][0] for k in b)
    p = {k: round(1 / (1 + math.exp(-(z + w[mode, k][0]))), 9) for k in range(N) if w[mode, k][1] and (k not in others or k == a[2])}
    order = sorted(p, key=lambda k: (-p[k], k))
    return len(p), p[order[0]], p[order[len(p) // 2]], sum(p.values()) / len(p), p[order[-1]], order.index(a[2]) + 1 if a[2] in p else None


def test_equals_plain(spark):
    w, s = strengths(spark)
    rng = np.random.default_rng(2)
    rows = [(k, "xy"[k % 2], p[:3].tolist(), p[3:6].tolist()) for k, p in ((k, rng.permutation(N)) for k in range(80))] + [(99, "x", [1, 2, 3], [3, 2, 4])]
    got = {r["match_id"]: r for r in decide.pick_chances(spark.createDataFrame(rows, SCHEMA).repartition(3), s, "mode", 10).collect()}
    assert len(got) == 81
    for k, mode, a, b in rows:
        want = plain(w, mode, a, b)
        assert tuple(got[k])[2:] == pytest.approx(want) if want[-1] else (tuple(got[k])[2:-1] == pytest.approx(want[:-1]) and got[k]["actual_rank"] is None)


def test_odd_rows(spark):
    _, s = strengths(spark)
    rows = [(1, "x", [1, 2, 900], [3, 4, 6]), (2, "z", [1, 2, 3], [4, 6, 7]), (3, None, [1, 2, 3], [4, 6, 7]), (4, "x", [1, 2], [4, 6, 7]), (5, "x", None, [4, 6, 7]), (6, "x", [1, 2, None], [4, 6, 7]), (7, "x", [1, 2, -1], [4, 6, 7])]
    d = spark.createDataFrame(rows, SCHEMA)
    (r,) = decide.pick_chances(d, s, "mode", 10).collect()
    assert r["match_id"] == 1 and r["actual_rank"] is None and r["n_free"] == 24 - 5
    assert decide.pick_chances(d, s, "mode", 20).count() == 0
    assert decide.pick_chances(d.limit(0), s, "mode").count() == 0 and decide.pick_chances(d, s.limit(0), "mode").count() == 0
