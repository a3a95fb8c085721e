"""Steps whose work grows with the tables: each is done once for a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trifold.functions.expr import norm_tag
from trifold.operators import decide, fit, normalize
from trifold.plans import models
from trifold.streaming import controller


def test_tags_are_normalised_once_for_an_item(spark):
    raw = spark.createDataFrame([("{}", "#a")], "item string, queried_tag string")
    plan = normalize.participants(normalize.matches(normalize.parse(raw)))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line.split("(")[0]]
    assert filters and not any("upper(" in line for line in filters)


def test_tags_of_any_form(spark):
    tags = [" ##ab#c ", "x", "#", "##", "  ", "", None, "# a"]
    rows = spark.createDataFrame(list(enumerate(tags)), "k int, t string").select("k", norm_tag("t").alias("t"), norm_tag(norm_tag(F.col("t"))).alias("again"))
    got = {r["k"]: (r["t"], r["again"]) for r in rows.collect()}
    assert [got[k][0] for k in range(len(tags))] == ["#AB#C", "#X", None, None, None, None, None, "# A"]
    assert all(one == two for one, two in got.values())


class Handle:
    """Stands in for a state store: counts what a tag's rows ask of it."""

    def __init__(self):
        self.asked, self.values, self.timers = 0, {}, []

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.asked += 1
                return handle.values.get(name)

            def update(self, value):
                handle.asked += 1
                handle.values[name] = value

            def clear(self):
                handle.asked += 1
                handle.values.pop(name, None)

        return Value()

    def listTimers(self):
        self.asked += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.asked += 1
        self.timers.append(at)


class Mark:
    def getCurrentWatermarkInMs(self):
        return 100_000


def test_a_tag_asks_the_state_store_a_few_times_for_any_number_of_polls():
    handle, polls = Handle(), controller.Polls()
    polls.init(handle)
    batches = [[("#A", 200 - k, k, k % 24, None) for k in range(50)], [("#A", 60 + k, None, 3, None) for k in range(80)]]
    for asked, batch in zip((4, 6), batches, strict=True):
        handle.asked = 0
        (row,) = polls.handleInputRows(("#A",), iter(batch), Mark())
        assert handle.asked <= asked and len(handle.timers) == 1
    every = sorted((r[1:4] for b in batches for r in b), key=lambda p: (p[0], p[1] is not None, p[1] or 0, p[2]))
    # Polls that the watermark had not passed stayed, and were folded in their place.
    n, interval, empties, losses, activity, last = controller.advance(controller.START, every)
    assert tuple(row)[:8] == ("#A", n, interval, empties, losses, empties <= controller.PATIENCE, activity, last)
    assert handle.timers == [(last + interval) * 1000] and handle.values["settled"][0] == sum(p[0] <= 100 for p in every)


def test_nested_samples_read_the_matches_once(spark):
    rows = [(k, f"m{k % 2}", k % 3, [k % 5, k % 5 + 1, 9], [3 - k % 2, 7, 8], int(k % 7 < 3)) for k in range(400)]
    d = spark.createDataFrame(rows, "match_id long, mode string, map_id int, a array<int>, b array<int>, y int")
    half, draw, families, sizes = F.col("match_id") % 2, F.col("match_id") * 37 % 100 / 100, ["solo", "solo_mode", "solo_map"], [0.25, 0.5, 1.0]
    cells, samples = models._nested(d, families, half, draw, sizes)
    plain = lambda df: sorted((r["mode"], r["map_id"], r["a"], r["b"], r["w"], round(r["y"], 12), r["offset"]) for r in df.collect())
    for (s, h), sample in samples.items():
        assert plain(sample) == plain(fit.alike(d.where((half == h) & (draw < s)), families))
    w = spark.createDataFrame([(x, (x * 5 % 7 - 2) / 3) for x in range(10)], "brawler_id int, w double")
    got = decide.agreement(cells, w, sizes, F.col("half"), F.col("draw"), least=14, weight="n")
    near = lambda df: [tuple(pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in r) for r in sorted(df.collect())]
    assert [tuple(r) for r in sorted(got.collect())] == near(decide.agreement(d, w, sizes, half, draw, least=14))
    c = spark.createDataFrame([("solo:3", 1.0), ("solo_mode:m1:7", 0.5), ("solo_map:2:9", 2.0)], "feature string, beta double")
    assert sorted(decide.map_strengths(c, cells, weight="n").collect()) == sorted(decide.map_strengths(c, d).collect())
