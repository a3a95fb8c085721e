"""Ban values by rollouts against full enumeration of a small pool."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from trifold.operators import factors, rollout


def small_pool(n=8, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.8, n), factors.symmetric(rng.normal(0, 0.3, (n, n))), factors.antisymmetric(rng.normal(0, 1, (n, n))), rng.random(n) + 0.1


def exact(a, b, q, solo, ally, against, banned=None):
    """Expected chance of team A over all ordered ways to fill the open places."""
    team = rollout.places(len(a), len(b))
    free = [k for k in range(len(q)) if k not in (*a, *b, banned)]
    total = 0.0
    for picks in permutations(free, len(team)):
        p, left = 1.0, sum(q[k] for k in free)
        for k in picks:
            p, left = p * q[k] / left, left - q[k]
        x = [*a, *[k for k, t in zip(picks, team, strict=True) if t == "A"]]
        y = [*b, *[k for k, t in zip(picks, team, strict=True) if t == "B"]]
        z = factors.scores(solo, ally, against, np.array([x]), np.array([y]))[0]
        total += p / (1 + np.exp(-z))
    return total


def test_equals_enumeration(spark):
    solo, ally, against, q = small_pool()
    rows = 4000
    d = spark.createDataFrame([(k, 5, [0, 6, 7], [3, 6, 7]) for k in range(rows)], "match_id long, map_id int, a array<int>, b array<int>").repartition(3)
    got = {r["brawler_id"]: r for r in rollout.ban_values(d, solo, ally, against, {5: q}, rollouts=16).collect()}
    base = exact([0], [3], q, solo, ally, against)
    for k in range(8):
        want = 0.0 if k in (0, 3) else exact([0], [3], q, solo, ally, against, k) - base
        assert got[k]["value"] == pytest.approx(want, abs=0.006) and got[k]["n_drafts"] == rows
    again = {r["brawler_id"]: r["value"] for r in rollout.ban_values(d.repartition(1), solo, ally, against, {5: q}, rollouts=16).collect()}
    assert again == pytest.approx({k: r["value"] for k, r in got.items()}, abs=1e-12)


def test_a_ban_moves_later_picks_up():
    solo, ally, against, q = small_pool()
    noise = rollout.uniform(np.arange(3), 5, 8)
    a, b = np.array([[0]] * 3), np.array([[3]] * 3)
    picks, base, without = rollout.values(a, b, np.log(q)[None].repeat(3, 0), noise, solo, ally, against)
    assert rollout.places(1, 1) == ["B", "A", "A", "B"] and picks.shape == (3, 5, 4)
    order = np.argsort(-(np.log(q) - np.log(-np.log(noise))), axis=2)
    for i in range(3):
        for r in range(5):
            free = [k for k in order[i, r].tolist() if k not in (0, 3)]
            assert picks[i, r].tolist() == free[:4]
            for s in range(4):
                left = [k for k in free if k != free[s]][:4]
                z = factors.scores(solo, ally, against, np.array([[0, left[1], left[2]]]), np.array([[3, left[0], left[3]]]))[0]
                assert without[i, r, s] == pytest.approx(1 / (1 + np.exp(-z)))
    assert 0 < noise.min() and noise.max() < 1 and abs(noise.mean() - 0.5) < 0.1


def test_drafts_with_a_repeated_pick_are_left_out(spark):
    solo, ally, against, q = small_pool()
    d = spark.createDataFrame([(1, 5, [0], [0])], "match_id long, map_id int, a array<int>, b array<int>")
    assert rollout.ban_values(d, solo, ally, against, {5: q}).count() == 0
