"""Rows of a design as bytes, made once for all the rungs of a ladder."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import convex, design, fit, simulate
from trifold.plans import models
from trifold.session import durable
from trifold.sources.bind import CLASSES, TRAITS


def _drafts(spark, n=900):
    traits = {t: (F.col("match_id") % 3 - 1) / k for k, t in enumerate(TRAITS, 1)}
    more = {"mode": F.concat(F.lit("m:"), F.col("match_id") % 2), "map_id": (F.col("match_id") % 3).cast("int"), "power": F.col("match_id") % 7 / 4 - 0.7, "mastery": F.col("match_id") % 5 * 100.0 - 200, "tier": F.col("match_id") % 2}
    others = {"patch": F.lit("p"), "hour": F.col("match_id") % 24, "popularity": F.rand(1)}
    return durable(simulate.drafts(spark, n, n=12, spread=0.5).withColumns(more | others | traits))


def _sums(made):
    """Weight and wins of the rows of equal entries."""
    w, won = Counter(), Counter()
    for r in made.data.collect():
        key = tuple(sorted((k, round(v, 9)) for k, v in zip(r["number"], r["value"], strict=True)))
        w[key] += r["w"]
        won[key] += r["w"] * r["y"]
    return {(k, c): x for c, of in (("w", w), ("won", won)) for k, x in of.items()}


@pytest.mark.parametrize("n", [5, 1 << 17])
def test_packed_rows_come_back(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(0, 6, 100)
    sizes[:20] = 0  # a packed row without entries
    own = [rng.normal(size=100) for _ in range(3)]
    number, value = rng.integers(0, n, sizes.sum()), rng.choice([-1, 1, 127, -127, 128, -128, 0.25, 1e300, -3.5], sizes.sum())
    batch = convex.pack(*own, sizes, number, value, n, ["x"])
    assert batch.num_rows == 7 and batch.column("names").to_pylist() == [["x"], *[None] * 6]
    for got, want in zip(convex.unpack(batch), (*own, sizes, number, value), strict=True):
        assert np.array_equal(got, want)
    at, part = sizes[:48].sum(), convex.unpack(batch.slice(3))
    for got, want in zip(part, (*[x[48:] for x in own], sizes[48:], number[at:], value[at:]), strict=True):
        assert np.array_equal(got, want)


def test_slices_add_up(spark, monkeypatch):
    """Losses, gradients and second derivatives don't depend on how many entries are taken at once; packed rows are those with lists."""
    made = fit.prepare(_drafts(spark), ["solo", "solo_mode", "counter", "power"])
    beta, at = np.random.default_rng(2).normal(0, 0.2, len(made.names)), np.array([0, 3, 14, len(made.names) - 1])
    all_of = lambda rows: (*convex.logistic(rows, len(beta))(beta), convex.logistic_curvature(rows, beta), convex.logistic_block(rows, beta, at))
    want = all_of(made.data)
    for taken in (7, 1 << 16):
        monkeypatch.setattr(convex, "TAKEN", taken)
        for got, x in zip(all_of(made.packed), want, strict=True):
            assert got == pytest.approx(x)


def test_rows_of_some_families(spark):
    """What is left of rows that were made for more families is what is made for some alone; each family's names have its block."""
    d = _drafts(spark)
    for f in design.FAMILIES:
        names = d.select(F.explode(design.entries([f])).alias("e")).select(F.substring_index("e.feature", ":", 1)).distinct().collect()
        assert [r[0] for r in names] == [fit.BLOCKS.get(f, f)], f
    whole = fit.prepare(d, ["solo", "solo_mode", "synergy", "theory", "structure", "power", "mastery", "side"])
    for some in (["solo"], ["solo", "synergy", "side"], ["theory", "power", "mastery"], ["structure", "solo_mode"]):
        part, alone = whole.within(some), fit.prepare(d, some)
        assert part.names == alone.names and part.total == alone.total == 900
        assert _sums(part) == pytest.approx(_sums(alone))
        assert fit.fit(part, some).beta == pytest.approx(fit.fit(alone, some).beta, abs=1e-3)


def test_class_features_by_hand(spark):
    d = _drafts(spark, 200)
    got = {r["match_id"]: {e["feature"]: e["value"] for e in r["e"]} for r in d.select("match_id", design.entries(["theory", "structure"]).alias("e")).collect()}
    for r in d.collect():
        a, b = ([CLASSES[k % len(CLASSES)] for k in t] for t in (r["a"], r["b"]))
        want = {f"theory:{c}": a.count(c) - b.count(c) for c in CLASSES}
        want |= {f"structure:{t}:{c}": want[f"theory:{c}"] * r[t] for t in TRAITS for c in CLASSES}
        want["theory:coverage"] = len(set(a)) - len(set(b))
        want["theory:redundancy"] = max(map(a.count, a)) - max(map(b.count, b))
        want["theory:artillery_only"] = ("artillery" in a and "artillery" not in b) - ("artillery" in b and "artillery" not in a)
        hunt = lambda x, y: x.count("assassin") * (y.count("artillery") + y.count("marksman"))
        want["theory:hunt"] = hunt(a, b) - hunt(b, a)
        assert got[r["match_id"]] == pytest.approx(want)


def test_a_rung_begins_with_what_is_known(spark):
    """M4 begins with M2, and its counters with M3's: that is nearer to where it ends, which is the same place."""
    d, families = _drafts(spark), ["solo", "synergy", "counter"]
    made = fit.prepare(d, families)
    two = [fit.fit(made.within(["solo", f]), ["solo", f]) for f in families[1:]]
    begun = models._begun(two)
    assert begun.families == two[0].families and set(begun.names) == set(made.names) and models._begun([]) is None
    known = dict(zip(begun.names, begun.beta, strict=True))
    assert all(known[f] == x for f, x in zip(two[0].names, two[0].beta, strict=True))
    assert all(known[f] == x for f, x in zip(two[1].names, two[1].beta, strict=True) if f.startswith("ctr:"))
    m, plain = fit.fit(made, families, start=begun), fit.fit(made, families, start=two[0])
    far = lambda x: np.linalg.norm([dict(zip(x.names, x.beta, strict=True)).get(f, 0.0) - beta for f, beta in zip(m.names, m.beta, strict=True)])
    assert far(begun) < far(two[0]) / 2 and m.iterations <= plain.iterations and m.beta == pytest.approx(plain.beta, abs=1e-3)


def test_a_ladder_makes_its_rows_once(spark, sf, monkeypatch):
    """Matches are grouped once for all rungs that read teams, mode and map, again only from those rows or for what more a rung reads;
    entries are made as often, and the later matches scored once; rows are those of each rung by itself."""
    calls, made, alike, entries = [], [], fit.alike, design.entries
    monkeypatch.setattr(fit, "alike", lambda d, families, *more: calls.append((len(families), "w" in d.columns)) or alike(d, families, *more))
    monkeypatch.setattr(design, "entries", lambda families: made.append(list(families)) or entries(families))
    two = ["solo", "solo_mode"]
    ladder = [("M0", ["solo"]), ("M1", two), ("M2", [*two, "synergy"]), ("M6", [*two, "synergy", "structure"]), ("M8", [*two, "power"]), ("P_mode", two)]
    monkeypatch.setattr(models, "LADDER", ladder)
    rows = {r["rung"]: r for r in models.ablation_ladder(spark, sf).collect()}
    assert calls == [(4, False), (1, True), (3, False)]
    assert len(made) == 4  # the rows of the three groupings, and the later matches
    train, test = models._context(spark, sf, [f for _, families in ladder for f in families])
    for name, families in ladder:
        m = fit.fit(train, families)
        want = models._quality(m.predict(test)).first()
        got = rows[name]
        assert (got["families"], got["params"], got["n"]) == ("+".join(families), len(m.names), want["n"])
        assert got["log_loss"] == pytest.approx(want["log_loss"], abs=2e-5) and got["auc"] == pytest.approx(want["auc"], abs=1e-3)
