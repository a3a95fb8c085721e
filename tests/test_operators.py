"""Operators on small frames with known answers."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.operators import comps, corpus, decide, design, lookup, metrics, normalize, pairs, ranking, resample, simulate, textkb
from trifold.plans import streams
from trifold.schemas import feature_safe
from trifold.streaming import controller


def test_row_number_and_bins(spark):
    for n, k in ((6, 4), (7, 4), (10, 5), (23, 10)):
        df = spark.range(n).select(F.col("id"), (F.col("id") * 7 % n).alias("v"))
        rows = ranking.row_number(df, [F.col("v"), F.col("id")]).orderBy("rn").collect()
        assert [r["rn"] for r in rows] == list(range(1, n + 1)) and [r["v"] for r in rows] == sorted(r["v"] for r in rows)
        edges = [(f * n) // k for f in range(k + 1)]
        got = spark.range(n).select(ranking.equal_count_bin(F.col("id") + 1, n, k)).collect()
        assert [g[0] for g in got] == [max(f for f in range(k) if edges[f] <= t) for t in range(n)]


def test_metrics(spark):
    df = spark.createDataFrame([(k, p, y) for k, (p, y) in enumerate(zip([0.1, 0.4, 0.4, 0.6, 0.6, 0.9], [0, 0, 1, 1, 0, 1], strict=True))], "id int, p double, y int")
    assert metrics.auc(df).first()["auc"] == pytest.approx(0.7777777778)
    assert tuple(metrics.losses(df).first())[:2] == pytest.approx((0.5108256238, 0.1766666667))
    assert metrics.ece(metrics.calibration(df, "id", 4)).first()[0] == pytest.approx(0.2)
    assert metrics.auc(df.where("y = 1")).first()["auc"] is None


def test_false_discovery(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.001, 0.02, 0.03, 0.04, 0.2])], "k int, p double")
    out = ranking.false_discovery(df, "p", "k").collect()
    assert sum(r["fdr"] for r in out) == 4 and sum(r["bonferroni"] for r in out) == 1


def test_order_statistics(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 1, 9, 3]], "v int")
    got = {r["p"]: r["v"] for r in ranking.order_statistic(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1, 0.5: 3, 0.9: 5, 1.0: 9}


def test_order_statistics_of_keys(spark):
    """Keys that spread over all ranges, a null one, and values repeated often."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([None, *range(9)]) if k % 3 else rng.randrange(1000)) for k in range(900)] + [("z", 4)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(r["k"], r["p"]): r["v"] for r in ranking.order_statistic(df.where("v IS NOT NULL"), "v", [0.0, 0.3, 0.9, 1.0], ["k"]).collect()}
    middle = {r["k"]: r["m"] for r in ranking.median(df, "v", ["k"], "m").collect()}
    for k in {k for k, _ in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert middle[k] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        for p in (0.0, 0.3, 0.9, 1.0):
            assert got[k, p] == v[int(p * (len(v) - 1))]
    assert ranking.median(df.limit(0), "v", ["k"]).count() == 0


def test_spearman(spark):
    df = spark.createDataFrame([(k, float(k), float(-k)) for k in range(9)], "id int, x double, y double")
    assert ranking.spearman(df, "x", "y", "id").first()["rho"] == pytest.approx(-1)


TAGS = ["#AAA", "#BBB", "#CCC", "#DDD", "#EEE", "#FFF"]


def item(tags=TAGS, result="victory", mode="ballGame", kind="soloRanked", change=None, teams=None, players=None):
    teams = teams if teams is not None else [[{"tag": t, "brawler": {"id": k, "power": 9}} for k, t in enumerate(tags[: len(tags) // 2])], [{"tag": t, "brawler": {"id": 9 + k, "power": 9}} for k, t in enumerate(tags[len(tags) // 2 :])]]
    battle = {"mode": mode, "type": kind, "result": result, "trophyChange": change, "teams": teams}
    if players:
        battle = {"mode": mode, "type": kind, "players": [{"tag": t} for t in players]}
    return json.dumps({"battleTime": "20260804T131108.000Z", "event": {"id": 1, "mode": "", "map": "M"}, "battle": battle})


CASES = [
    (item(), "#AAA", 0), (item(result="defeat"), "#DDD", 0), (item(result="defeat"), "#AAA", 1), (item(TAGS[3:] + TAGS[:3]), "#AAA", 1), (item(["aaa", "#bbb", *TAGS[2:]]), "AAA", 0),
    (item(result="draw"), "#AAA", None), (item(), "#ZZZ", "not present"), (item(kind="ranked"), "#AAA", 0), (item([f"#T{k}" for k in range(10)]), "#T0", 0), (item(players=TAGS), "#AAA", "flat players"),
    (item(teams=[[{"tag": "#A"}], [{"tag": "#B"}], [{"tag": "#C"}]]), "#A", "expected 2 teams"), (item(["#AAA"] * 6), "#AAA", "duplicate tag"), (item(result=None, change=8), "#AAA", 0), (item(result=None, change=-8), "#AAA", 1),
    (item(result=None, change=0), "#AAA", None), ("[]", "#AAA", "not an object"), (item(teams=[[], [{"tag": "#B"}]]), "#B", "empty team"), (item(teams=[[{"tag": "#A"}, {"tag": " "}], [{"tag": "#B"}]]), "#B", "missing tag"),
]


def test_normalize(spark):
    raw = spark.createDataFrame([(k, i, q) for k, (i, q, _) in enumerate(CASES)], "k int, item string, queried_tag string")
    parsed = normalize.parse(raw)
    reasons = {r["k"]: r["reject_reason"] for r in parsed.collect()}
    for k, (_, _, want) in enumerate(CASES):
        assert reasons[k] == (want if isinstance(want, str) else None), k
    m = normalize.matches(parsed)
    rows = sorted(m.collect(), key=lambda r: r["item"] if "item" in r.asDict() else "")
    want = sorted(str(w) for _, _, w in CASES if not isinstance(w, str))
    assert sorted(str(r["winning_team_idx"]) for r in rows) == want
    assert {r["match_id"] for r in rows if r["team_size"] == 3 and r["all_tags"][0] in TAGS} == {"dd7be983b2bc608a563b58d61c45154637c08091"}
    assert normalize.participants(m).count() == sum(2 * r["team_size"] for r in rows)
    assert sum(r["is_ranked"] == 0 for r in rows) == 1
    assert normalize.rejects(parsed).count() == sum(isinstance(w, str) for _, _, w in CASES)


TRANSITIONS = [
    ((7200, 0, 23, False), (3600, 0, True, True, "suspected_loss")), ((3600, 0, 25, True), (1800, 0, True, False, "first_poll_backfill")), ((3600, 0, 8, False), (3600, 0, True, False, "in_band")),
    ((3600, 0, 15, False), (2880, 0, True, False, "approaching_capacity")), ((3600, 0, 1, False), (5400, 0, True, False, "sparse")), ((3600, 0, 0, False), (7200, 1, True, False, "empty")),
    ((3600, 5, 9, False), (3600, 0, True, False, "in_band")), ((900, 0, 25, False), (900, 0, True, True, "suspected_loss")), ((1209600, 0, 1, False), (1209600, 0, True, False, "sparse")),
]


@pytest.mark.parametrize(("state", "want"), TRANSITIONS)
def test_controller_step(state, want):
    assert controller.step(*state) == want


def test_controller_fold(spark):
    rng = random.Random(3)
    polls = [(tag, e, e, rng.choice([0, 0, 1, 5, 16, 23])) for tag in range(5) for e in range(rng.randint(1, 30))] + [(9, k, k, 0) for k in range(7)]
    df = spark.createDataFrame(polls, "tag long, epoch long, event_id long, new_matches int")
    got = {r["tag"]: r for r in controller.fold(df).collect()}
    for tag in {p[0] for p in polls}:
        interval, empties, losses = controller.FIRST, 0, 0
        for k, (_, _, _, n) in enumerate(sorted(p for p in polls if p[0] == tag)):
            interval, empties, active, loss, _ = controller.step(interval, empties, n, k == 0)
            losses += loss
        assert (got[tag]["interval"], got[tag]["empties"], got[tag]["losses"], got[tag]["active"]) == (interval, empties, losses, active)
    assert got[9]["interval"] == 460800 and got[9]["empties"] == 7 and not got[9]["active"]
    # Tags of many polls go through their task in order, whatever the batches are.
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        many = controller.fold(df.unionByName(df.where("tag = 1").withColumn("tag", F.lit(None).cast("long"))).repartition(7), most=6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["tag"]: r for r in many if r["tag"] is not None} == got
    assert [tuple(r)[1:] for r in many if r["tag"] is None] == [tuple(got[1])[1:]]


def states(df):
    return {r["tag"]: (r["polls"], r["interval"], r["empties"], r["losses"], r["active"], round(r["activity"], 6), r["last_poll"]) for r in df.collect()}


def test_folds_agree_on_any_key(spark):
    """String tags, a null one, polls without a time, a number or an id: the fold of arrays and the sorted one give the same."""
    rng = random.Random(7)
    rows = [(rng.choice(["#A", "#B", "#C", None]), rng.choice([None, *range(0, 90_000, 700)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 16, 30])) for _ in range(400)]
    df = spark.createDataFrame(rows, "tag string, epoch long, event_id long, new_matches int")
    one, two = states(controller.fold(df)), states(controller.fold(df, most=5))
    assert one == two and set(one) == {"#A", "#B", "#C", None}
    for tag in one:
        polls = sorted((p[1:] for p in rows if p[0] == tag and p[1] is not None and p[3] is not None), key=lambda p: (p[0], p[1] is not None, p[1] or 0, p[2]))
        n, interval, empties, losses, activity, last = controller.advance(controller.START, polls)
        assert one[tag] == (n, interval, empties, losses, empties <= 6, round(activity, 6), last)


def test_stream_of_late_polls(spark, tmp_path):
    """Polls in any order over many files, with a stop between: the state equals the fold in order of time."""
    rng = random.Random(9)
    source, base = tmp_path / "in", str(tmp_path / "out")
    schema = "tag string, epoch long, event_id long, new_matches int"
    rows = [(rng.choice(["#A", "#B", "#C"]), 1_000_000 + 600 * k, k, rng.choice([None, 0, 1, 5, 16, 23])) for k in range(120)]
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 6 * 3600))
    far = [("#D", 9_000_000 + k, 200 + k, 5) for k in range(40)]  # two files on, so that the others' next polls are due
    rows, late = rows + far, late + far
    for at in range(0, 160, 20):
        spark.createDataFrame(late[at : at + 20], schema).coalesce(1).write.mode("append").parquet(str(source))
        if at in (40, 140):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            out = streams.run(controller.stream(stream, "8 hours"), "update", base)
    assert out.select("batch").distinct().count() >= 6
    last = lookup.latest(out.where("event = 'state'"), ["tag"], ["batch"])
    assert states(last) == states(controller.fold(spark.createDataFrame(rows, schema)))
    due = out.where("event = 'due'").collect()
    assert {r["tag"] for r in due} == {r["tag"] for r in last.where("active AND tag <> '#D'").collect()} and due
    assert all(r["due_at"] == r["last_poll"] + r["interval"] for r in due)


def test_stream_dedup_of_shuffled_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5), 1000 + k, k) for k in range(90)]
    rng.shuffle(rows)
    for at in range(0, 90, 15):
        spark.createDataFrame(rows[at : at + 15], "k int, ts long, event_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts long, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lookup.latest(streams.run(controller.first_seen(stream, ["k"], ["ts", "event_id"]), "update"), ["k"], ["batch"])
    assert {r["k"]: r["event_id"] for r in out.collect()} == {k: min(r[2] for r in rows if r[0] == k) for k in {r[0] for r in rows}}


def test_stream_resumes(spark, tmp_path):
    """A stream that is started again in its old folder goes on from its state and reads only new files."""
    source, base = tmp_path / "in", str(tmp_path / "out")
    polls = lambda rows: spark.createDataFrame(rows, "tag long, epoch long, event_id long, new_matches int")
    first, later = [(1, 10, 1, 0), (1, 20, 2, 0), (2, 5, 3, 23)], [(1, 30, 4, 23), (3, 40, 5, 5)]
    for rows in (first, later):
        polls(rows).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("tag long, epoch long, event_id long, new_matches int").parquet(str(source))
        out = streams.run(controller.stream(stream), "update", base).where("event = 'state'")
    assert states(lookup.latest(out, ["tag"], ["batch"])) == states(controller.fold(polls(first + later)))
    assert sorted((r["tag"], r["batch"]) for r in out.where("batch > 0").collect()) == [(1, 1), (3, 1)]


def drafts(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.sample(range(107), 3), rng.sample(range(107), 3), rng.randint(0, 1), "m", 1) for k in range(n)]
    return spark.createDataFrame(rows, "match_id long, a array<int>, b array<int>, y int, mode string, map_id int")


def test_design_is_antisymmetric(spark):
    d = drafts(spark)
    differences = ["power", "mastery", "popularity"]
    d = d.withColumns({"patch": F.lit("p"), "tier": F.when(F.col("match_id") % 3 > 0, F.col("match_id") % 3)} | {c: F.col("match_id") % 7 - 3.5 for c in differences})
    swapped = d.select("match_id", F.col("b").alias("a"), F.col("a").alias("b"), "y", "mode", "map_id", "patch", "tier", *[(-F.col(c)).alias(c) for c in differences])
    families = [f for f in design.FAMILIES if f != "side"]
    one, two = design.rows(d, families), design.rows(swapped, families).withColumnRenamed("value", "other")
    both = one.join(two, ["match_id", "feature"], "full")
    assert both.where("value + other <> 0 OR value IS NULL OR other IS NULL").count() == 0
    mirror = d.withColumn("b", F.col("a")).withColumns(dict.fromkeys(differences, F.lit(0.0)))
    assert design.rows(mirror, families).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([([5, 1, 3], [1, 9, 2])], "a array<int>, b array<int>")
    got = df.select(pairs.same_team("a").alias("s"), pairs.cross_team("a", "b").alias("c"), pairs.triple("a").alias("t")).first()
    assert [tuple(x) for x in got["s"]] == [(1, 3), (1, 5), (3, 5)] and got["t"] == "1,3,5"
    assert len(got["c"]) == 8 and {tuple(x) for x in got["c"]} >= {(5, 1, -1), (1, 9, 1), (3, 2, -1)}
    assert pairs.pair_domain(spark, 107).count() == 5671


def test_catalogue():
    kinds = [f for f, _ in comps.families()]
    assert (kinds.count("triple"), kinds.count("pair"), kinds.count("single")) == (84, 21, 7)


def test_assemble(spark):
    m = spark.createDataFrame([(k,) for k in range(5)], "match_id long")
    full = [(t, s, 10 * t + s) for t in (0, 1) for s in range(3)]
    rows = [(0, t, s, i, "#x", 3.0, 8.0) for t, s, i in full] + [(1, t, s, 7, "#x", None, None) for t, s, _ in full] + [(2, 0, 0, 1, "#x", 1.0, 1.0)] + [(3, 0, s, s, "#x", 1.0, 1.0) for s in range(6)]
    p = spark.createDataFrame(rows, "match_id long, team_idx int, slot int, brawler_id int, player_tag string, power double, trophies double")
    got = {r["match_id"]: r for r in corpus.assemble(m, p).collect()}
    assert [got[k]["drop_reason"] for k in range(5)] == ["ok", "dupBrawler", "wrongCount", "badTeams", "noPlayers"]
    assert got[0]["a"] == [0, 1, 2] and got[0]["b"] == [10, 11, 12] and got[0]["power_diff"] == 0
    assert {r["match_id"]: r["drop_reason"] for r in corpus.assemble(m, p, known_ids=12).collect()}[0] == "unknownBrawler"


def test_side_swap(spark):
    d = drafts(spark, 2000).withColumn("y", F.lit(1))
    assert 0.45 < corpus.swap_sides(d).agg(F.avg("y")).first()[0] < 0.55


def test_interval_lookup(spark):
    seg = spark.createDataFrame([("p1", 0, 10), ("p2", 10, 20), ("p3", 20, None)], "patch_id string, start int, stop int")
    df = spark.createDataFrame([(-1,), (0,), (9,), (10,), (25,), (None,)], "t int")
    got = {r["t"]: r["patch_id"] for r in lookup.interval(df, seg, "t", ["patch_id"]).collect()}
    assert got == {-1: None, 0: "p1", 9: "p1", 10: "p2", 25: "p3", None: None}


def test_interval_lookup_of_many_segments(spark):
    """100,000 segments with gaps, repeated times, one time with a third of the rows, nulls: carried along, and as arrays where few."""
    seg = spark.range(100_000).selectExpr("CAST(id AS STRING) AS patch_id", "CAST(id * 10 AS INT) AS start", "CAST(id * 10 + 7 AS INT) AS stop")
    df = spark.range(9000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 500003 WHEN id = 1 THEN NULL ELSE id * 113 % 1000100 - 50 END AS INT) AS t", "id AS patch_no", "array(id) AS more")
    rows = lookup.interval(df, seg, "t", ["patch_id"]).collect()
    assert len(rows) == 9000 and rows[0].asDict().keys() == {"t", "patch_no", "more", "patch_id"}
    for r in rows:
        want = None if r["t"] is None or r["t"] < 0 or r["t"] % 10 >= 7 or r["t"] // 10 >= 100_000 else str(r["t"] // 10)
        assert r["patch_id"] == want, r
    few = seg.where("start < 3000")
    same = [sorted(map(str, lookup.interval(df.where("t < 4000"), few, "t", ["patch_id"], most=m).collect())) for m in (5, 1000)]
    assert same[0] == same[1]


def test_upserts(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (2, 1, "z")], "k int, v int, s string")
    assert {r["k"]: r["s"] for r in lookup.latest(a, ["k"], ["v"]).collect()} == {1: "y", 2: "z"}
    assert [tuple(r) for r in lookup.insert_new(a.where("k = 1"), a, ["k"]).select("k", "s").collect()] == [(2, "z")]
    changes = spark.createDataFrame([(1, None, "new")], "k int, v int, s string")
    assert sorted(tuple(r) for r in lookup.overwrite(a, changes, ["k"]).collect()) == [(1, 1, "new"), (1, 3, "new"), (2, 1, "z")]


def test_decisions(spark):
    w = spark.createDataFrame([(k, float(k)) for k in range(12)], "brawler_id int, w double")
    d = spark.createDataFrame([(1, [0, 1, 5], [2, 3, 4], 1, 7)], "match_id long, a array<int>, b array<int>, y int, map_id int")
    got = decide.last_pick(d, w).first()
    assert (got["n_free"], got["best"], got["worst"], got["actual"], got["actual_rank"]) == (7, 11.0, 5.0, 5.0, 7)
    none = spark.createDataFrame([], "i int, j int, w double")
    got = decide.best_after_reply(d, w, none).first()
    assert (got["match_id"], got["pick"], got["value"]) == (1, 11, 1.0)
    assert (got["greedy"], got["greedy_value"]) == (11, 1.0)
    counters = spark.createDataFrame([(6, 11, 9.0), (11, 6, -9.0)], "i int, j int, w double")
    assert decide.best_after_reply(d, w, counters).first()["value"] >= -4


def test_bootstrap_covers_truth(spark):
    rng = np.random.default_rng(5)
    rows = [(m, "g", float(0.3 + e)) for m, e in enumerate(rng.normal(0, 1, 3000))] + [(m, "null", float(e)) for m, e in enumerate(rng.normal(0, 1, 3000))]
    got = {r["grp"]: r for r in resample.group_means(spark.createDataFrame(rows, "m long, grp string, v double"), "grp", "v", "m").collect()}
    assert got["g"]["low"] < 0.3 < got["g"]["high"] and got["g"]["p"] == 1 / 200 and got["g"]["p_normal"] < 1e-6
    assert got["g"]["error"] == pytest.approx(1 / 3000**0.5, rel=0.25)
    assert got["null"]["p"] > 1e-3


def test_simulated_teams(spark):
    d = simulate.drafts(spark, 400)
    assert d.where("size(array_distinct(a)) < 3 OR size(array_distinct(b)) < 3 OR array_max(concat(a, b)) > 106").count() == 0
    assert 0.4 < d.agg(F.avg("y")).first()[0] < 0.6


def test_captions(spark):
    srt = "1\n00:00:00,000 --> 00:00:02,000\nwe go <i>left</i> now\n\n2\n00:00:02,000 --> 00:00:04,000\nleft now and win\n\n3\n00:00:35,500 --> 00:00:40,000\nand win the game\n"
    files = spark.createDataFrame([("f", srt)], "path string, text string")
    assert textkb.without_overlap(textkb.cues(files)).first()["text"] == "[00:00] we go left now and win [00:35] the game"


def test_markup(spark):
    page = "{{MatchList|x}}{{Match|date=2026-01-02\n|opponent1={{TeamOpponent|X}}\n}}{{MapVeto|no}}{{Map|map=A <!-- c -->|maptype=ball|t1c1=r|t1b1=q|score1=2|score2=0|winner=1}}{{Match|date=2026-01-03}}{{Map|map=B}}"
    rows = textkb.template_records(spark.createDataFrame([("p", page)], "page string, text string")).orderBy("pos").collect()
    assert [(r["date"], r["map"], r["maptype"], r["score1"]) for r in rows] == [("2026-01-02", "A", "ball", "2"), ("2026-01-03", "B", None, None)]
    nested = "{{Match|opponent1={{TeamOpponent|X}}|date=2026-02-01|m={{Map|map={{Link|A|map=no}}|maptype=ball|t1c1=[[r|s]]|score1=2}} }}{{Map|map=open"
    (row,) = textkb.template_records(spark.createDataFrame([("p", nested), ("q", None), ("r", "}} {{Map|map=A}} {{")], "page string, text string")).collect()
    assert (row["date"], row["map"], row["maptype"], row["t1c1"], row["score1"]) == ("2026-02-01", "{{Link|A|map=no}}", "ball", "[[r|s]]", "2")


def test_template_names_of_any_length():
    name = "a" * 300
    assert textkb.templates("{{" + name + "|x}} {{b") == [(name, 0, 306), ("b", 307, 310)]


def test_rank_sums_beyond_a_long(spark):
    both = spark.range(3_000_000).select("id", F.col("id").alias("x"), (-F.col("id")).alias("y"))
    assert ranking.spearman(both, "x", "y", "id").first()["rho"] == pytest.approx(-1)
    many = spark.createDataFrame([(0.2, 0), (0.7, 1)], "p double, y int").withColumn("y", F.col("y").cast("decimal(20,0)") * F.lit(4 * 10**9).cast("decimal(20,0)"))
    counts = many.withColumn("y", F.col("y").cast("long"))
    assert metrics.auc(counts.where("y = 0").unionByName(counts.where("y > 0"))).first()["n_pos"] == 4 * 10**9


def test_feature_allow_list(spark):
    df = spark.createDataFrame([(1, 2)], "match_id int, duration int")
    assert feature_safe(df, ["match_id"]).columns == ["match_id"]
    with pytest.raises(ValueError, match="duration"):
        feature_safe(df, ["match_id", "duration"])


def test_paired_difference(spark):
    rng = np.random.default_rng(9)
    rows = [(k, float(x), float(x - 0.05 + e)) for k, (x, e) in enumerate(zip(rng.random(2000), rng.normal(0, 0.2, 2000), strict=True))]
    got = resample.paired_difference(spark.createDataFrame(rows, "k long, a double, b double"), "a", "b", "k").first()
    assert got["low"] < 0.05 < got["high"] and got["matters"] and got["high"] - got["low"] < 0.03
    none = resample.paired_difference(spark.createDataFrame([(k, 1.0, 1.0) for k in range(50)], "k long, a double, b double"), "a", "b", "k").first()
    assert none["delta"] == 0 and not none["matters"]
