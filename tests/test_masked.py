"""Completed drafts against plain enumeration of a small pool."""

from __future__ import annotations

import numpy as np
import pytest

from trifold.operators import factors, masked, rollout


def model(n=9, seed=4):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.8, n), factors.symmetric(rng.normal(0, 0.5, (n, n))), factors.antisymmetric(rng.normal(0, 1, (n, n)))


def z(m, a, b):
    """Log odds of a over b with any number of picks, term by term."""
    solo, ally, against = m
    team = lambda t: sum(solo[i] for i in t) + sum(ally[i, j] for x, i in enumerate(t) for j in t[x + 1 :])
    return team(a) - team(b) + sum(against[i, j] for i in a for j in b)


def ranked(m, own, other, plied):
    free = [k for k in range(len(m[0])) if k not in (*own, *other)]
    now = lambda k: z(m, [*own, k], other)
    after = lambda k: min(z(m, [*own, k], [*other, j]) for j in free if j != k)
    return sorted(free, key=lambda k: (-round(after(k) if plied else now(k), 9), k))


def play(m, a, b, k, plied):
    order = rollout.ORDER
    known, open_ = order[: 6 - k], order[6 - k :]
    us = open_[0]
    teams = {"A": list(a[: known.count("A")]), "B": list(b[: known.count("B")])}
    them, first = "AB"[us == "A"], None
    for at, t in enumerate(open_):
        look = plied and t == us and them in open_[at:]
        best = ranked(m, teams[t], teams["AB"[t == "A"]], look)
        first = first or best
        teams[t].append(best[0])
    return first, 1 / (1 + np.exp(-z(m, teams[us], teams[them])))


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_equals_plain_play(spark, k):
    m, rng = model(), np.random.default_rng(k)
    rows = [(i, *np.split(rng.permutation(9)[:6], 2)) for i in range(60)]
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, a, b in rows], "match_id long, a array<int>, b array<int>").repartition(3)
    got = {r["match_id"]: r for r in masked.completed(d, *m, k, 0.5).collect()}
    assert len(got) == 60
    us = rollout.ORDER[6 - k]
    n_own, n_other = rollout.ORDER[: 6 - k].count(us), 6 - k - rollout.ORDER[: 6 - k].count(us)
    for i, a, b in rows:
        own, other = (a, b) if us == "A" else (b, a)
        taken = {*own[:n_own].tolist(), *other[:n_other].tolist()}
        for name, plied in (("greedy", False), ("plied", True)):
            first, p = play(m, a.tolist(), b.tolist(), k, plied)
            assert got[i][name] == first[0] and got[i][f"{name}_p"] == pytest.approx(p)
            assert got[i][f"{name}_punished"] == any(m[2][j, first[0]] >= 0.5 for j in range(9) if j not in taken)
            assert got[i][f"actual_{name}"] == first.index(own[n_own]) + 1


def test_odd_rows(spark):
    m = model()
    rows = [(1, [0, 1, 2], [2, 3, 4]), (2, [0, 1], [2, 3, 4]), (3, None, [1, 2, 3]), (4, [0, 1, 99], [2, 3, 4]), (5, [0, 1, None], [2, 3, 4])]
    d = spark.createDataFrame(rows, "match_id long, a array<int>, b array<int>")
    got = masked.completed(d, *m, 2, 0.5).collect()
    assert [r["match_id"] for r in got] == [1] and got[0]["actual_greedy"] == 0
    assert masked.completed(d.limit(0), *m, 2, 0.5).count() == 0
    assert masked.summary(masked.completed(d.limit(0), *m, 2, 0.5)).first()["n"] == 0
    for k in (0, 5):
        with pytest.raises(ValueError, match="open"):
            masked.completed(d, *m, k, 0.5)
