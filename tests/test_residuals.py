"""Residuals over fitted strengths, the map's structure and rows that SQL can't give, against plain computations."""

from __future__ import annotations

import json
import struct
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trifold.functions.text import csv_line, fixed, padded, percent, points
from trifold.operators import decide, design, power
from trifold.plans import models, registry
from trifold.plans.decisions import weights
from trifold.sources import bind, files

registry.load()


@pytest.fixture(scope="module")
def drafts(spark, sf):
    return bind.decided(spark, sf).select("match_id", "mode", "map_id", "a", "b", "y").orderBy("match_id").collect()


@pytest.fixture(scope="module")
def expected(drafts):
    """Chances of the first team by a dense ridge fit of strengths."""
    x = np.zeros((len(drafts), bind.N))
    for i, r in enumerate(drafts):
        for team, sign in ((r["a"], 1), (r["b"], -1)):
            for k in team:
                x[i, k] += sign
    y, b = np.array([r["y"] for r in drafts], float), np.zeros(bind.N)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 25 * np.eye(bind.N), x.T @ (p - y) + 25 * b)
    return 1 / (1 + np.exp(-x @ b))


def _sides(drafts, expected):
    for r, p in zip(drafts, expected.tolist(), strict=True):
        yield r, r["a"], r["y"] - p
        yield r, r["b"], (1 - r["y"]) - (1 - p)


def test_picks_over_the_fit(spark, sf, drafts, expected):
    want = defaultdict(list)
    for _, team, e in _sides(drafts, expected):
        for i, j in combinations(sorted(team), 2):
            want["pair", f"{i},{j}"].append(e)
        want["triple", ",".join(map(str, sorted(team)))].append(e)
    got = {(r["kind"], r["picks"]): r for r in models.pick_fit_residual(spark, sf).collect()}
    assert set(got) == {k for k, v in want.items() if k[0] == "pair" or len(v) >= 2}
    for k, r in got.items():
        assert r["n"] == len(want[k]) and r["total"] == pytest.approx(sum(want[k]), abs=2e-4) and r["mean"] == pytest.approx(np.mean(want[k]), abs=2e-4)


def test_compositions_over_the_fit(spark, sf, drafts, expected):
    want = defaultdict(list)
    for _, team, e in _sides(drafts, expected):
        short = sorted(bind.CLASSES[k % 7][:3] for k in team)
        want["triple", "+".join(short)].append(e)
        for x in set(short):
            want["single", x].append(e)
        for x in combinations(sorted(set(short)), 2):
            want["pair", "+".join(x)].append(e)
    got = {(r["family"], r["label"]): r for r in models.comp_fit_residual(spark, sf).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r["n"] == len(want[k]) and r["mean"] == pytest.approx(np.mean(want[k]), abs=2e-4)


def test_seats_over_the_fit(spark, sf, drafts, expected):
    want = defaultdict(list)
    for r, p in zip(drafts, expected.tolist(), strict=True):
        want[r["mode"]].append((r["y"], p))
    got = {r["mode"]: r for r in models.seat_fit_residual(spark, sf).collect()}
    assert set(got) == set(want)
    for mode, r in got.items():
        y, p = np.array(want[mode]).T
        half = 1.96 * np.std(y - p, ddof=1) / np.sqrt(len(y))
        assert (r["n"], r["rate"]) == (len(y), pytest.approx(y.mean(), abs=1e-5))
        for c, v in (("expected", p.mean()), ("residual", (y - p).mean()), ("low", (y - p).mean() - half), ("high", (y - p).mean() + half)):
            assert r[c] == pytest.approx(v, abs=2e-4)


def test_structure_is_antisymmetric(spark, sf):
    d = bind.decided(spark, sf).withColumns(bind.map_traits())
    swapped = d.withColumns({"a": F.col("b"), "b": F.col("a")})
    one, two = (design.rows(x, ["structure"]).groupBy("feature").agg(F.round(F.sum("value"), 6).alias("v")) for x in (d, swapped))
    assert one.join(two.withColumnRenamed("v", "w"), "feature").where(F.abs(F.col("v") + F.col("w")) > 1e-6).count() == 0
    unknown = d.withColumns({"open": F.lit(None).cast("double"), "cover": F.lit(None).cast("double")})
    assert design.rows(unknown, ["structure"]).count() == 0


def _hash(value: int, seed: int = 42, kind: str = "<q") -> int:
    """Hash of a long or an int as Spark has it, as a signed number."""
    h = xxhash.xxh64(struct.pack(kind, value), seed).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_sides_swapped(spark, sf, drafts):
    flip = [_hash(r["match_id"], xxhash.xxh64(b"side", 42).intdigest()) % 2 == 1 for r in drafts]
    (row,) = registry.QUERIES["side_swap"](spark, sf).collect()
    assert row["n"] == len(drafts) and row["before"] == pytest.approx(np.mean([r["y"] for r in drafts]))
    assert row["after"] == pytest.approx(np.mean([1 - r["y"] if f else r["y"] for r, f in zip(drafts, flip, strict=True)]))


def test_stable_bans(spark, sf):
    w = {r["brawler_id"]: r["w"] for r in weights(spark).collect()}
    draws = bind.drafts(spark, sf).select("match_id", "map_id", F.concat("a", "b").alias("t")).collect()
    poisson = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(8)])
    count = defaultdict(lambda: np.zeros(21))
    for r in draws:
        times = np.array([1.0] + [np.sum(_hash(5000 + b, _hash(r["match_id"]) % (1 << 64), "<i") % (1 << 40) / (1 << 40) >= poisson) for b in range(20)])
        for k in r["t"]:
            count[r["map_id"], k] += times
    want = {}
    for m in {m for m, _ in count}:
        lists = [[k for _, k in sorted((-n[b] * max(w[k], 0.0), k) for (x, k), n in count.items() if x == m and n[b] > 0)[:5]] for b in range(21)]
        share = [len(set(x) & set(lists[0])) / len(lists[0]) for x in lists[1:] if x]
        want[m] = np.mean(share), min(share)
    got = decide.ban_stability(bind.drafts(spark, sf), weights(spark)).collect()
    assert {r["map_id"]: pytest.approx((r["mean_share"], r["least_share"]), abs=1e-6) for r in got} == want


def test_agreement_of_given_lists(spark, sf):
    """The two lists of split_half with weights that are given."""
    d = bind.decided(spark, sf).select("match_id", "map_id", "a", "b")
    w = {r["brawler_id"]: r["w"] for r in weights(spark).collect()}
    half = F.col("match_id") % 2
    lists = [decide.ban_list(d.where(half == k), weights(spark)) for k in (0, 1)]
    got = {r["map_id"]: r["captured"] for r in decide.captured(lists[0], lists[1], 5).collect()}
    count = [defaultdict(lambda: defaultdict(int)) for _ in range(2)]
    for r in d.collect():
        for k in [*r["a"], *r["b"]]:
            count[r["match_id"] % 2][r["map_id"]][k] += 1
    value = [{m: {k: n / sum(c.values()) * max(w[k], 0.0) for k, n in c.items()} for m, c in h.items()} for h in count]
    first = lambda v: [k for _, k in sorted((-x, k) for k, x in v.items())[:5]]
    assert set(got) == set(value[1])
    for m, truth in value[1].items():
        best = sum(truth[k] for k in first(truth))
        mine = sum(truth.get(k, 0.0) for k in first(value[0].get(m, {})))
        assert got[m] == pytest.approx(mine / best if best > 0 else 1.0)


def test_power_by_drawing(spark, sf):
    """The joint tests' sizes and power against draws of the law that they are about."""
    rng = np.random.default_rng(3)
    for df, variance in ((10, 0.02), (106, 0.05)):
        n = power.matches_needed(df, variance, 0.05)
        law = rng.noncentral_chisquare(df, n * variance / 4, 400_000)
        level = np.quantile(rng.chisquare(df, 400_000), 0.95)
        assert (law > level).mean() == pytest.approx(0.8, abs=0.01)
        assert power.power(df, n * variance / 4, 0.05) == pytest.approx((law > level).mean(), abs=0.01)
    rows = {r["test"]: r for r in registry.QUERIES["power_table"](spark, sf).collect()}
    reached = {r["test"]: r for r in registry.QUERIES["achieved_power"](spark, sf).collect()}
    q = defaultdict(int)
    for r in bind.drafts(spark, sf).select(F.concat("a", "b").alias("t")).collect():
        for k in r["t"]:
            q[k] += 1
    share = np.array(list(q.values())) / sum(q.values())
    sigma = power.sigma_from_auc(0.56)
    want = {"solo": (len(q) - 1, sigma**2), "synergy": (len(q) * (len(q) - 1) // 2, sigma**2 * (1 - (share**2).sum()) / 3)}
    want["counter"], want["both"] = want["synergy"], (2 * want["synergy"][0], 2 * want["synergy"][1])
    for name, (df, variance) in want.items():
        assert rows[name]["df"] == df and rows[name]["variance"] == pytest.approx(variance, abs=1e-5)
        assert reached[name]["power"] == pytest.approx(power.power(df, reached[name]["n_train"] * variance / 4, 0.05 / 6), abs=1e-3)


def test_formats(spark):
    df = spark.createDataFrame([(0.52314, 'a "b", c', 7), (-0.004, "two\nlines", None), (0.0, None, 0)], "x double, s string, n int")
    rows = df.select(fixed("x", 3).alias("f"), percent("x").alias("p"), points("x").alias("pp"), padded("s", 9).alias("l"), padded("s", 10, right=True).alias("r"), csv_line("s", "n", "x").alias("c")).collect()
    assert [(r["f"], r["p"], r["pp"]) for r in rows] == [("0.523", "52.3%", "+52.31pp"), ("-0.004", "-0.4%", "-0.40pp"), ("0.000", "0.0%", "+0.00pp")]
    assert [r["l"] for r in rows] == ['a "b", c ', "two\nlines", None] and rows[0]["r"] == '  a "b", c'
    assert [r["c"] for r in rows] == ['"a ""b"", c",7,0.52314', '"two\nlines",,-0.004', ",0,0.0"]


def test_records_of_other_shapes(spark, tmp_path):
    maps = tmp_path / "maps.csv"
    maps.write_text(json.dumps({"m1": {"mode": "heist", "size": 3, "more": [1]}, "m2": {"size": 4}}))
    rows = files.records(spark, str(maps), "mode:string,size:int").orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("m1", "heist", 3), ("m2", None, 4)]
    listed = tmp_path / "list.json"
    listed.write_text(json.dumps({"data": {"items": [{"id": 5}, {"id": None}]}}))
    assert [tuple(r) for r in files.records(spark, str(listed), "id:int", at="data.items", name="place").orderBy("place").collect()] == [("0", 5), ("1", None)]
    broken = tmp_path / "broken.csv"
    broken.write_text("no json")
    assert files.records(spark, str(broken), "id:int").count() == 0 and files.records(spark, str(listed), "id:int", at="none").count() == 0
