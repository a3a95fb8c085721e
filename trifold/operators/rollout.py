"""Bans as interventions on the shared pool: what a draft is worth with a character out for both teams.

A draft's open places are filled by a continuation policy that draws each pick among
the free characters with chances in proportion to their popularity.  Drawing in turn
without replacement is the same as taking the characters in descending order of
log popularity plus Gumbel noise, so one rollout is one such order, and a ban leaves
the order as it is (common random numbers): it only matters to rollouts that pick the
banned character, whose later picks then move up by one.  So each rollout is
valued once as it is and once without each of its picks, all in arrays over a batch
of drafts; noise comes from a hash of match, rollout and character, so results don't
depend on partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.operators.factors import scores

#: The order in which teams pick, and rollouts of a draft.
ORDER, ROLLOUTS = "ABBAAB", 16


def uniform(match: np.ndarray, rollouts: int, n: int, seed: int = 3) -> np.ndarray:
    """Numbers between 0 and 1, drawn by match, rollout and character."""
    x = match.astype(np.uint64)[:, None, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(rollouts, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03) + np.arange(n, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def places(known_a: int, known_b: int) -> list[str]:
    """Teams of the open places, in order, after the first picks of each team."""
    left, out = {"A": known_a, "B": known_b}, []
    for team in ORDER:
        if left[team]:
            left[team] -= 1
        else:
            out.append(team)
    return out


def values(a: np.ndarray, b: np.ndarray, log_q: np.ndarray, noise: np.ndarray, solo: np.ndarray, ally: np.ndarray, against: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of drafts with known picks a and b (a row each): the picks of each rollout in order, team A's chance to win, and its chance without each of these picks.

    log_q: log popularity by draft and character; noise: by draft, rollout and character."""
    m, r, n = noise.shape
    key = log_q[:, None, :] - np.log(-np.log(noise))
    taken = np.concatenate([a, b], axis=1)
    np.put_along_axis(key, np.repeat(taken[:, None, :], r, axis=1), -np.inf, axis=2)
    team = places(a.shape[1], b.shape[1])
    k = len(team)
    order = np.argsort(-key, axis=2, kind="stable")[:, :, : k + 1]
    own, other = ([s for s, t in enumerate(team) if t == x] for x in "AB")

    def chance(picks: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.repeat(a[:, None, :], r, axis=1), picks[:, :, own]], axis=2).reshape(m * r, -1)
        y = np.concatenate([np.repeat(b[:, None, :], r, axis=1), picks[:, :, other]], axis=2).reshape(m * r, -1)
        return (1 / (1 + np.exp(-scores(solo, ally, against, x, y)))).reshape(m, r)

    without = [chance(np.delete(order, s, axis=2)) for s in range(k)]
    return order[:, :, :k], chance(order[:, :, :k]), np.stack(without, axis=2)


def ban_values(drafts: DataFrame, solo: np.ndarray, ally: np.ndarray, against: np.ndarray, popularity: dict[int, np.ndarray], known: tuple[int, int] = (1, 1), rollouts: int = ROLLOUTS) -> DataFrame:
    """Per map and character: how team A's chance changes, on average over drafts and rollouts, when the character is out for both teams.

    drafts: match_id, map_id, a, b, of which the first ``known`` picks are on the
    board, none of them twice; popularity: of the characters by map, over 0.  Sums
    of a task's drafts are added up before any shuffle."""
    held = drafts.sparkSession.sparkContext.broadcast((solo, ally, against, {k: np.log(q) for k, q in popularity.items()}))
    columns = [F.col("match_id").cast("long").alias("match_id"), F.col("map_id").cast("int").alias("map_id"), F.slice("a", 1, known[0]).cast("array<int>").alias("a"), F.slice("b", 1, known[1]).cast("array<int>").alias("b")]
    first = drafts.select(*columns).where(F.size(F.array_distinct(F.concat("a", "b"))) == sum(known))

    def run(batches):
        solo, ally, against, log_q = held.value
        total: dict[int, np.ndarray] = {}
        n_drafts: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = (batch.column(c).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1) for c in ("a", "b"))
                maps = batch.column("map_id").to_numpy()
                noise = uniform(batch.column("match_id").to_numpy(), rollouts, len(solo))
                picks, base, without = values(a, b, np.stack([log_q[k] for k in maps.tolist()]), noise, solo, ally, against)
                change = (without - base[:, :, None]) / rollouts
                for k in np.unique(maps).tolist():
                    mine = maps == k
                    total[k] = total.get(k, 0) + np.bincount(picks[mine].ravel(), change[mine].ravel(), minlength=len(solo))
                    n_drafts[k] = n_drafts.get(k, 0) + int(mine.sum())
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), n_drafts[k]))], names=["map_id", "brawler_id", "total", "n"])

    parts = first.mapInArrow(run, "map_id int, brawler_id int, total double, n long")
    return parts.groupBy("map_id", "brawler_id").agg((F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("n_drafts"))
