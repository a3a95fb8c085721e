"""Decisions from weights: ban lists, last picks and replies.

weights: brawler_id, w, a dimension of the characters; it is checked and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trifold.functions.expr import sigmoid
from trifold.operators.resample import POISSON
from trifold.session import durable, small

MOST = 5000


def weight_map(weights: DataFrame) -> DataFrame:
    """One row with all weights as an array over ids from 0; their number is checked."""
    n = weights.count()
    if n > MOST:
        raise ValueError(f"{n} characters; at most {MOST} are broadcast")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("brawler_id").cast("int").alias("k"), F.col("w").cast("double").alias("w"))))
    return F.broadcast(weights.agg(F.map_from_entries(pairs).alias("_w")))


def total(team) -> Column:
    team = F.col(team) if isinstance(team, str) else team
    return F.aggregate(team, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.element_at("_w", x.cast("int")), F.lit(0.0)))


def score(drafts: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds z, the difference of the teams' weights, and p, the chance that team 0 wins."""
    df = drafts.crossJoin(weight_map(weights)).withColumn("z", total("a") - total("b"))
    return df.withColumn("p", sigmoid("z")).drop("_w")


def ban_list(drafts: DataFrame, weights: DataFrame, key: str = "map_id") -> DataFrame:
    """Share of picks times positive weight per map, ranked."""
    picks = drafts.select(key, F.explode(F.concat("a", "b")).alias("brawler_id"))
    n = picks.groupBy(key, "brawler_id").agg(F.count(F.lit(1)).alias("n"))
    slots = n.withColumn("slots", F.sum("n").over(Window.partitionBy(key)))
    value = F.col("n") / F.col("slots") * F.greatest(F.element_at("_w", F.col("brawler_id").cast("int")), F.lit(0.0))
    out = slots.crossJoin(weight_map(weights)).select(key, "brawler_id", "n", value.alias("value"))
    order = Window.partitionBy(key).orderBy(F.desc("value"), "brawler_id")
    return out.withColumn("rank", F.row_number().over(order))


def captured(list_: DataFrame, truth: DataFrame, k: int, key: str = "map_id") -> DataFrame:
    """Per map, the true value of the list's first k as a share of that of the true first k; 1 where there is nothing to gain."""
    best = truth.where(F.col("rank") <= k).groupBy(key).agg(F.sum("value").alias("best"))
    got = list_.where(F.col("rank") <= k).select(key, "brawler_id").join(truth.select(key, "brawler_id", "value"), [key, "brawler_id"], "left")
    got = got.groupBy(key).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("got"))
    return best.join(got, key, "left").select(key, F.when(F.col("best") > 0, F.coalesce("got", F.lit(0.0)) / F.col("best")).otherwise(1.0).alias("captured"))


def last_pick(drafts: DataFrame, weights: DataFrame) -> DataFrame:
    """What the last pick of team 0 could have been: best, median and worst weight among the free ones, and the rank of the actual one.

    The actual pick has neither weight nor rank (0) if it was taken before."""
    n = weights.count()
    if n > MOST:
        raise ValueError(f"{n} characters; at most {MOST} are broadcast")
    rows = weights.select(F.col("brawler_id").cast("int").alias("k"), F.col("w").cast("double").alias("w")).orderBy(F.desc("w"), "k").collect()
    held = drafts.sparkSession.sparkContext.broadcast((np.array([r["k"] for r in rows]), np.array([r["w"] for r in rows])))
    taken = F.concat(F.slice("a", 1, 2), F.col("b"), F.slice("a", 3, 1)).cast("array<int>").alias("taken")
    return drafts.select(F.col("match_id").cast("long").alias("match_id"), taken).mapInArrow(_candidates(held), "match_id long, n_free int, best double, median double, worst double, actual double, actual_rank long")


def _candidates(held):
    """The free characters of a batch of matches at once, in order of weight; the last one taken is the actual pick."""

    def run(batches):
        ids, w = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = np.array(batch.column("taken").slice(at, 4096).to_pylist(), dtype=np.int64).reshape(-1, 6)
                free = ~(ids[None, :, None] == part[:, None, :5]).any(axis=2)
                place, n = np.cumsum(free, axis=1), free.sum(axis=1)
                row = np.arange(len(part))
                pick = lambda k: w[((place == k[:, None]) & free).argmax(axis=1)]  # noqa: B023, E731
                is_own = (ids[None, :] == part[:, 5:]) & free
                own, known = is_own.argmax(axis=1), is_own.any(axis=1)
                columns = [n.astype(np.int32), pick(np.minimum(1, n)), pick((n - 1) // 2 + 1), pick(n)]
                actual = pa.array(w[own], mask=~known)
                yield pa.RecordBatch.from_arrays([batch.column("match_id").slice(at, 4096), *map(pa.array, columns), actual, pa.array(np.where(known, place[row, own], 0))], names=["match_id", "n_free", "best", "median", "worst", "actual", "actual_rank"])

    return run


def pick_chances(drafts: DataFrame, strengths: DataFrame, cell: str, least: int = 20) -> DataFrame:
    """What team 0's last pick is worth as a chance to win: match_id, the cell, n_free, best, median, mean and worst chance, and actual_rank.

    strengths: the cell (a mode, say), brawler_id from 0, w, served; only served
    characters that nobody else has can be picked, and a match with fewer than ``least`` of
    them is left out.  The median is the candidate at place floor(n / 2), from 0, in
    descending order.  Characters without a row count 0 and aren't served; the rank of
    an actual pick that isn't served is null.  Teams that aren't three are left out."""
    rows = strengths.select(F.col(cell).alias("cell"), F.col("brawler_id").cast("int").alias("k"), F.col("w").cast("double").alias("w"), "served").where("k >= 0")
    cells, top = rows.agg(F.count_distinct("cell"), F.max("k")).first()
    n = 1 + (-1 if top is None else top)
    if n > MOST or cells * n > 200 * MOST:
        raise ValueError(f"{cells} cells of {n} characters; at most {MOST} characters and {200 * MOST} strengths are broadcast")
    w: dict[str, np.ndarray] = {}
    served: dict[str, np.ndarray] = {}
    for r in rows.collect():  # checked above
        w.setdefault(r["cell"], np.zeros(n))[r["k"]] = r["w"]
        served.setdefault(r["cell"], np.zeros(n, dtype=bool))[r["k"]] = r["served"]
    held = drafts.sparkSession.sparkContext.broadcast((w, served, n))
    inside = F.forall(F.concat("a", "b"), lambda x: x.isNotNull() & (x >= 0))
    whole = drafts.where((F.size("a") == 3) & (F.size("b") == 3) & inside & F.col(cell).isNotNull())
    picks = whole.select(F.col("match_id").cast("long").alias("match_id"), F.col(cell), F.concat("a", "b").cast("array<int>").alias("picks"))
    schema = f"match_id long, {picks.schema[cell].simpleString().replace(':', ' ')}, n_free int, best double, median double, mean double, worst double, actual_rank int"

    def run(batches):
        w, served, n = held.value
        nothing = np.zeros(n), np.zeros(n, dtype=bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                picks = part.column("picks").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, 6)
                names = part.column(cell).to_pylist()
                strength = np.stack([w.get(c, nothing[0]) for c in names])
                can = np.stack([served.get(c, nothing[1]) for c in names])
                known = np.where(picks < n, picks, 0)
                own = np.where(picks < n, np.take_along_axis(strength, known, axis=1), 0.0) if n else np.zeros(picks.shape)
                for k in (0, 1, 3, 4, 5):  # the last of team 0 stays a candidate
                    at_k = np.flatnonzero(picks[:, k] < n)
                    at_k = at_k[picks[at_k, k] != picks[at_k, 2]]
                    can[at_k, picks[at_k, k]] = False
                base = own[:, 0] + own[:, 1] - own[:, 3:].sum(axis=1)
                p = np.where(can, np.round(1 / (1 + np.exp(-(base[:, None] + strength))), 9), -1.0)
                free = can.sum(axis=1)
                keep = np.flatnonzero(free >= max(least, 1))
                if not len(keep):
                    continue
                p, free, actual, row = p[keep], free[keep], picks[keep, 2], np.arange(len(keep))
                order = -np.sort(-p, axis=1)
                is_known = actual < n
                mine = np.where(is_known, p[row, np.where(is_known, actual, 0)], -1.0)
                ahead = ((p > mine[:, None]) | ((p == mine[:, None]) & (np.arange(n)[None] < actual[:, None]))).sum(axis=1)
                columns = [free.astype(np.int32), order[:, 0], order[row, free // 2], np.where(p >= 0, p, 0.0).sum(axis=1) / free, order[row, free - 1]]
                chosen = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([chosen.column("match_id"), chosen.column(cell), *map(pa.array, columns), pa.array((ahead + 1).astype(np.int32), mask=mine < 0)], names=["match_id", cell, "n_free", "best", "median", "mean", "worst", "actual_rank"])

    return picks.mapInArrow(run, schema)


def best_after_reply(drafts: DataFrame, weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """One ply further: for each candidate the opponent's best reply counts.

    pairs: i, j, w with the counter weight of i against j (antisymmetric).  For
    team 0 with two picks and team 1 with two, the pick whose value after the
    best reply is highest, and that value.  Four picks are taken, so of each
    candidate's replies the first five are enough; those are a small table.  greedy is the pick of the highest weight, greedy_value
    what the best reply leaves of it."""
    strength = weights.select(F.col("brawler_id").cast("int").alias("j"), F.col("w").alias("wj"))
    reply = strength.crossJoin(F.broadcast(strength.select(F.col("j").alias("i")))).where("i <> j").join(pairs, ["i", "j"], "left")
    gain = F.col("wj") - F.coalesce("w", F.lit(0.0))
    reply = reply.select("i", "j", gain.alias("gain"))
    first = reply.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("gain"), "j"))).where("k <= 5")
    n = weights.count()
    if n > MOST:
        raise ValueError(f"{n} characters; at most {MOST} are broadcast")
    rows = first.orderBy("i", "k").collect()  # five for each character
    own = {r["brawler_id"]: r["w"] for r in weights.select(F.col("brawler_id").cast("int").alias("brawler_id"), "w").collect()}
    ids = np.array(sorted(own))
    replies, gains = np.full((len(ids), 5), -1), np.full((len(ids), 5), -np.inf)
    for r in rows:
        at = int(np.searchsorted(ids, r["i"]))
        replies[at, r["k"] - 1], gains[at, r["k"] - 1] = r["j"], r["gain"]
    held = drafts.sparkSession.sparkContext.broadcast((ids, np.array([own[i] for i in ids]), replies, gains))
    taken = F.concat(F.slice("a", 1, 2), F.slice("b", 1, 2)).cast("array<int>").alias("taken")
    return drafts.select(F.col("match_id").cast("long").alias("match_id"), taken).mapInArrow(_replies(held), "match_id long, pick int, value double, greedy int, greedy_value double")


def _replies(held):
    """All candidates of a batch of matches at once; as nested lambdas over arrays this takes some fifty times as long."""

    def run(batches):
        ids, w, replies, gains = held.value
        for batch in batches:
            taken = batch.column("taken")
            for at in range(0, batch.num_rows, 2048):
                part = np.array(taken.slice(at, 2048).to_pylist(), dtype=np.int64).reshape(-1, 4)
                gone = (replies[None, :, :, None] == part[:, None, None, :]).any(axis=3)
                loss = np.where(gone, -np.inf, gains[None]).max(axis=2)
                value = np.round(np.where((ids[None, :, None] == part[:, None, :]).any(axis=2), -np.inf, w[None] - loss), 9)
                best = value.argmax(axis=1)
                row = np.arange(len(best))
                greedy = np.where(np.isneginf(value), -np.inf, w[None]).argmax(axis=1)
                columns = [ids[best].astype(np.int32), value[row, best], ids[greedy].astype(np.int32), value[row, greedy]]
                yield pa.RecordBatch.from_arrays([batch.column("match_id").slice(at, 2048), *map(pa.array, columns)], names=["match_id", "pick", "value", "greedy", "greedy_value"])

    return run


def ban_stability(drafts: DataFrame, weights: DataFrame, k: int = 5, replicates: int = 20, key: str = "map_id", seed: int = 5) -> DataFrame:
    """Per map, which share of the first k bans comes back when matches are resampled: mean and least over the replicates.

    A match weighs a Poisson number in each replicate, drawn by hashing it; one
    aggregate sums all replicates side by side, so no row is multiplied."""
    draw = lambda b: F.pmod(F.xxhash64("match_id", F.lit(seed * 1000 + b)), F.lit(1 << 40)) / (1 << 40)
    times = lambda b: sum(((draw(b) >= float(c)).cast("int") for c in POISSON[:8]), F.lit(0))
    picks = drafts.select(key, "match_id", F.explode(F.concat("a", "b")).alias("brawler_id"))
    sums = picks.groupBy(key, "brawler_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(times(b)).alias(f"n{b}") for b in range(replicates)])
    each = sums.select(key, "brawler_id", F.posexplode(F.array("n", *[f"n{b}" for b in range(replicates)])).alias("b", "n")).where("n > 0")
    # Within a list of one map the slots are the same for all, so they don't change the order.
    value = F.col("n") * F.greatest(F.element_at("_w", F.col("brawler_id").cast("int")), F.lit(0.0))
    order = Window.partitionBy(key, "b").orderBy(F.desc("value"), "brawler_id")
    top = each.crossJoin(weight_map(weights)).select(key, "b", "brawler_id", value.alias("value")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    lists = top.groupBy(key, "b").agg(F.collect_list("brawler_id").alias("ids"))  # k of them
    full = lists.where("b = 0").select(key, F.col("ids").alias("full"))
    share = F.size(F.array_intersect("ids", "full")) / F.size("full")
    both = lists.where("b > 0").join(full, key).select(key, share.alias("share"))
    return both.groupBy(key).agg(F.avg("share").alias("mean_share"), F.min("share").alias("least_share"))


def map_strengths(coefficients: DataFrame, drafts: DataFrame, key: str = "map_id", weight: str | None = None) -> DataFrame:
    """Per map and character, the fitted strength on that map: of the character alone, in the map's mode and on the map itself.

    coefficients: feature, beta of the families solo, solo_mode and solo_map, any of
    them may be missing.  A map's mode is the one most of its drafts have (ties: the
    smallest).  Parts without a coefficient are 0.  ``weight``: how many drafts a row stands for."""
    part = F.split("feature", ":")
    block, who = F.get(part, F.lit(0)), F.element_at(part, -1).cast("int")
    # A mode's name may hold colons itself.
    cell = F.array_join(F.slice(part, 2, F.size(part) - 2), ":")
    rows = coefficients.where(block.isin("solo", "solo_mode", "solo_map")).select(block.alias("block"), who.alias("brawler_id"), cell.alias("cell"), "beta")
    order = Window.partitionBy(key).orderBy(F.desc("n"), "mode")
    modes = drafts.groupBy(key, "mode").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1").select(key, F.col("mode").cast("string").alias("mode"))
    parts = [("solo", F.lit("")), ("solo_mode", F.col("mode")), ("solo_map", F.col(key).cast("string"))]
    cells = modes.select(key, F.explode(F.array(*[F.struct(F.lit(b).alias("block"), c.alias("cell")) for b, c in parts])).alias("x"))
    return cells.select(key, "x.*").join(rows, ["block", "cell"]).groupBy(key, "brawler_id").agg(F.sum("beta").alias("w"))


def agreement(drafts: DataFrame, strengths: DataFrame, sizes: list[float], half: Column, draw: Column, k: tuple[int, int] = (3, 5), least: int = 0, key: str = "map_id", weight: str | None = None) -> DataFrame:
    """How ban lists of two halves of the matches agree, and what their difference costs, by the share of each half that is used.

    half is 0 or 1 for each match, draw a number from 0 to 1; a match takes part at
    the sizes above its draw, so smaller samples lie within larger ones and all of
    them are counted in one pass.  strengths: map, brawler_id, w and, where they
    were fitted for each sample, size and half too.  Per size, as means over
    maps of ``least`` matches or more that both halves have: the share of the
    first k bans that the lists have in common, the share of the second half's
    achievable value that the first half's first bans capture, and as baselines that
    of the most picked characters of all maps and the exact expectation of random ones.
    ``weight``: how many matches of the same half and sizes a row stands for."""
    many = F.col(weight) if weight else F.lit(1).cast("long")
    picks = drafts.select(key, half.alias("_half"), draw.alias("_draw"), many.alias("_many"), F.explode(F.concat("a", "b").cast("array<int>")).alias("brawler_id"))
    cells = [(s, h) for s in sizes for h in (0, 1)]
    counts = durable(picks.groupBy(key, "brawler_id").agg(F.sum("_many").alias("n_all"), *[F.sum(F.when((F.col("_half") == h) & (F.col("_draw") < s), F.col("_many")).otherwise(0)).alias(f"n{i}") for i, (s, h) in enumerate(cells)]))
    often = counts.groupBy("brawler_id").agg(F.sum("n_all").alias("n"))
    n_ids = often.count()
    if n_ids > MOST:
        raise ValueError(f"{n_ids} characters; at most {MOST} are ranked in one task")
    # One row a character, so its window is bounded by the check above.
    popular = often.select("brawler_id", F.row_number().over(Window.orderBy(F.desc("n"), "brawler_id")).alias("popular"))
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("size"), F.lit(h).alias("half"), F.col(f"n{i}").alias("n")) for i, (s, h) in enumerate(cells)]))
    kept = counts.withColumn("_picks", F.sum("n_all").over(Window.partitionBy(key))).where(F.col("_picks") >= 6 * least)
    long = kept.select(key, "brawler_id", each.alias("x")).select(key, "brawler_id", "x.*").where("n > 0")
    on = [c for c in ("size", "half", key, "brawler_id") if c in strengths.columns]
    list_ = Window.partitionBy(key, "size", "half")
    value = F.col("n") / F.sum("n").over(list_) * F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))
    ranked = long.join(strengths.select(*on, "w"), on, "left").withColumn("value", value).withColumn("r", F.row_number().over(list_.orderBy(F.desc("value"), "brawler_id")))
    of = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    sides = ranked.groupBy(key, "size", "brawler_id").agg(of(0, "r").alias("r0"), of(1, "r").alias("r1"), of(0, "n").alias("n0"), of(1, "n").alias("n1"), F.coalesce(of(1, "value"), F.lit(0.0)).alias("v"))
    within = lambda c, m: F.col(c) <= m
    value_of = lambda c: F.sum(F.when(within(c, k[0]), F.col("v")).otherwise(0.0))
    best = value_of("r1")
    captured_ = lambda got: F.when(best > 0, got / best).otherwise(1.0)
    by_map = sides.join(F.broadcast(popular), "brawler_id").groupBy(key, "size").agg(
        (F.sum("n0") / 6).alias("n_first"), (F.sum("n1") / 6).alias("n_second"), *[(F.count_if(within("r0", m) & within("r1", m)) / m).alias(f"overlap{i}") for i, m in enumerate(k, 1)],
        captured_(value_of("r0")).alias("captured"), captured_(value_of("popular")).alias("popular"), captured_(F.sum("v") * min(k[0], n_ids) / max(n_ids, 1)).alias("random"),
    )
    both = by_map.where("n_first > 0 AND n_second > 0")
    return both.groupBy("size").agg(F.count(F.lit(1)).alias("maps"), F.sum("n_first").cast("long").alias("n_first"), F.sum("n_second").cast("long").alias("n_second"), *[F.avg(c).alias(c) for c in ("overlap1", "overlap2", "captured", "popular", "random")])


def served(weights: DataFrame, picks: DataFrame, owned: DataFrame, least: int) -> DataFrame:
    """What a player is offered: the characters that they own (player, brawler_id) and that were
    picked ``least`` times or more (picks: brawler_id, a row each), ranked by weight."""
    often = picks.groupBy("brawler_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    offered = small(weights.join(often.select("brawler_id"), "brawler_id", "left_semi"), MOST)
    rows = owned.select("player", "brawler_id").distinct().join(offered, "brawler_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("w"), "brawler_id")))
