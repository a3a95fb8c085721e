"""Agreement of ban lists against plain Python, and strengths by map."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import decide


def drafts(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(k, int(k % 3), [int(x) for x in p[:3]], [int(x) for x in p[3:6]]) for k, p in ((k, rng.permutation(12)) for k in range(n))]
    return rows, spark.createDataFrame(rows, "match_id long, map_id int, a array<int>, b array<int>").repartition(3)


def lists(rows, w, map_id):
    n = {}
    for _, m, a, b in rows:
        if m == map_id:
            for x in (*a, *b):
                n[x] = n.get(x, 0) + 1
    slots = sum(n.values())
    value = {x: c / slots * max(w.get((map_id, x), 0.0), 0.0) for x, c in n.items()}
    return sorted(value, key=lambda x: (-value[x], x)), value


def test_equals_plain(spark):
    rows, d = drafts(spark)
    rng = np.random.default_rng(3)
    w = {(m, x): float(rng.normal()) for m in range(3) for x in range(11)}  # one character has none
    strengths = spark.createDataFrame([(m, x, v) for (m, x), v in w.items()], "map_id int, brawler_id int, w double")
    half, draw = F.col("match_id") % 2, F.col("match_id") * 37 % 100 / 100
    got = {r["size"]: r for r in decide.agreement(d, strengths, [0.3, 1.0], half, draw).collect()}
    every = [x for r in rows for x in (*r[2], *r[3])]
    popular = sorted(set(every), key=lambda x: (-every.count(x), x))[:3]
    for size in (0.3, 1.0):
        first, second = ([r for r in rows if r[0] % 2 == h and r[0] * 37 % 100 / 100 < size] for h in (0, 1))
        each = []
        for m in range(3):
            (l0, _), (l1, v) = lists(first, w, m), lists(second, w, m)
            best = sum(v[x] for x in l1[:3])
            gain = [sum(v.get(x, 0.0) for x in of) / best for of in (l0[:3], popular)]
            each.append([len({*l0[:3]} & {*l1[:3]}) / 3, len({*l0[:5]} & {*l1[:5]}) / 5, *gain, 3 / 12 * sum(v.values()) / best])
        r = got[size]
        assert [r[c] for c in ("overlap1", "overlap2", "captured", "popular", "random")] == pytest.approx(np.mean(each, axis=0).tolist())
        assert (r["maps"], r["n_first"], r["n_second"]) == (3, len(first), len(second))


def test_the_full_size_is_the_split(spark):
    rows, d = drafts(spark)
    w = spark.createDataFrame([(x, (x * 5 % 7 - 2) / 3) for x in range(12)], "brawler_id int, w double")
    half = [decide.ban_list(d.where(F.col("match_id") % 2 == k), w) for k in (0, 1)]
    want = decide.captured(half[0], half[1], 3).agg(F.avg("captured")).first()[0]
    (got,) = decide.agreement(d, w, [1.0], F.col("match_id") % 2, F.lit(0.5)).collect()
    assert got["captured"] == pytest.approx(want)
    # Weights that were fitted for each half.
    own = w.withColumn("half", F.lit(0)).unionByName(w.select("brawler_id", -F.col("w"), F.lit(1).alias("half")).toDF("brawler_id", "w", "half"))
    (other,) = decide.agreement(d, own, [1.0], F.col("match_id") % 2, F.lit(0.5)).collect()
    assert other["captured"] == 0.0


def test_few_matches_and_none(spark):
    rows, d = drafts(spark, 40)
    w = spark.createDataFrame([(0, 1.0)], "brawler_id int, w double")
    assert decide.agreement(d, w, [1.0], F.col("match_id") % 2, F.lit(0.5), least=14).first()["maps"] == 1  # only map 0 has 14
    assert decide.agreement(d.limit(0), w, [1.0], F.col("match_id") % 2, F.lit(0.5)).count() == 0
    assert decide.agreement(d, w, [0.1], F.col("match_id") % 2, F.lit(0.5)).count() == 0


def test_strengths_by_map(spark):
    c = [("solo:3", 1.0), ("solo_mode:1:URGENT:3", 0.5), ("solo_mode:2:HIGH:3", 9.0), ("solo_map:7:3", 0.25), ("solo:4", -1.0), ("solo_map:8:5", 2.0), ("syn:3", 50.0)]
    coefficients = spark.createDataFrame(c, "feature string, beta double")
    d = spark.createDataFrame([(1, 7, "1:URGENT"), (2, 7, "1:URGENT"), (3, 7, "2:HIGH"), (4, 8, "2:HIGH")], "match_id long, map_id int, mode string")
    got = {(r["map_id"], r["brawler_id"]): r["w"] for r in decide.map_strengths(coefficients, d).collect()}
    assert got == {(7, 3): 1.75, (7, 4): -1.0, (8, 3): 10.0, (8, 4): -1.0, (8, 5): 2.0}
