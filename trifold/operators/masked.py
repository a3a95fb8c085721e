"""Drafts without their last picks, completed by policies: what looking a reply ahead is worth.

The team whose turn comes first at the open places picks all of its own by one
of two policies: greedy takes the character that raises its chance most at once,
plied the one that leaves the best chance after the opponent's best reply, as
long as the opponent has a pick to come.  The opponent is a fixed adversary who
always takes its best reply.  The model's own chances of the finished drafts are
compared, so this measures the search and not the model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.operators.factors import scores
from trifold.operators.rollout import ORDER

#: Most characters: a state holds a table of picks and replies.
MOST = 1000

SCHEMA = "match_id long, greedy int, plied int, greedy_p double, plied_p double, greedy_punished boolean, plied_punished boolean, actual_greedy int, actual_plied int"


def gains(solo: np.ndarray, ally: np.ndarray, against: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """By state and character, what the character adds to the log odds of the team ``own``; -inf where it is taken."""
    out = solo[None] + ally[:, own].sum(axis=2).T + against[:, other].sum(axis=2).T
    np.put_along_axis(out, np.concatenate([own, other], axis=1), -np.inf, axis=1)
    return np.round(out, 9)


def replied(solo: np.ndarray, ally: np.ndarray, against: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """As ``gains``, less what the best reply among the other free characters gives back."""
    reply = gains(solo, ally, against, other, own)[:, None, :] - against[None]
    n = len(solo)
    reply[:, np.arange(n), np.arange(n)] = -np.inf
    return np.round(gains(solo, ally, against, own, other) - reply.max(axis=2), 9)


def finish(solo, ally, against, own: np.ndarray, other: np.ndarray, turns: list[bool], plied: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first pick's values by character, that pick, and the chance of ``own`` in the finished draft.

    turns: of the open places in order, whether they are our own; the first one is."""
    first = None
    for at, ours in enumerate(turns):
        if not ours:
            other = np.append(other, gains(solo, ally, against, other, own).argmax(axis=1)[:, None], axis=1)
            continue
        value = (replied if plied and False in turns[at:] else gains)(solo, ally, against, own, other)
        pick = value.argmax(axis=1)
        first = (value, pick) if first is None else first
        own = np.append(own, pick[:, None], axis=1)
    return *first, 1 / (1 + np.exp(-scores(solo, ally, against, own, other)))


def place_of(value: np.ndarray, actual: np.ndarray) -> np.ndarray:
    """Where the actual pick stands in a policy's order (ties: smaller ids first); 0 if it was taken before."""
    own = np.take_along_axis(value, actual[:, None], axis=1)
    ahead = (value > own) | ((value == own) & (np.arange(value.shape[1])[None] < actual[:, None]))
    return np.where(np.isneginf(own[:, 0]), 0, ahead.sum(axis=1) + 1)


def completed(drafts: DataFrame, solo: np.ndarray, ally: np.ndarray, against: np.ndarray, masked: int, hard: float) -> DataFrame:
    """Per match with its last ``masked`` picks (1 to 4) open: the first pick of either policy, the
    chances of the finished drafts, whether a free character counters that pick by ``hard``
    or more, and the place of the actual pick in the policy's order.

    solo, ally (symmetric) and against (antisymmetric) are over ids from 0; picks
    outside them leave their match out, as do teams that aren't three."""
    n = len(solo)
    if n > MOST:
        raise ValueError(f"{n} characters; at most {MOST} are sent to the tasks")
    if not 1 <= masked <= 4:
        raise ValueError("1 to 4 picks can be open")
    known, open_ = ORDER[: len(ORDER) - masked], ORDER[len(ORDER) - masked :]
    us = open_[0]
    turns, k_own, k_other = [t == us for t in open_], known.count(us), len(known) - known.count(us)
    own, other = ("a", "b") if us == "A" else ("b", "a")
    held = drafts.sparkSession.sparkContext.broadcast((solo, ally, against))
    cut = lambda c, k: F.slice(c, 1, k).cast("array<int>")
    inside = F.forall(F.concat("a", "b"), lambda x: x.isNotNull() & (x >= 0) & (x < n))
    whole = drafts.where((F.size("a") == 3) & (F.size("b") == 3) & inside)
    rows = whole.select(F.col("match_id").cast("long").alias("match_id"), cut(own, k_own).alias("own"), cut(other, k_other).alias("other"), F.get(own, F.lit(k_own)).cast("int").alias("actual"))
    step = max(1, 4_000_000 // (n * n))

    def run(batches):
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                mine, theirs = (part.column(c).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1) for c in ("own", "other"))
                actual = part.column("actual").to_numpy().astype(np.int64)
                got = [finish(*model, mine, theirs, turns, plied) for plied in (False, True)]
                free = np.ones((part.num_rows, len(model[0])), dtype=bool)
                np.put_along_axis(free, np.concatenate([mine, theirs], axis=1), False, axis=1)
                counter = [np.where(free, model[2][:, pick].T, -np.inf).max(axis=1) >= hard - 1e-9 for _, pick, _ in got]
                columns = [*[g[1].astype(np.int32) for g in got], *[g[2] for g in got], *counter, *[place_of(g[0], actual).astype(np.int32) for g in got]]
                yield pa.RecordBatch.from_arrays([part.column("match_id"), *map(pa.array, columns)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def summary(done: DataFrame, k: int = 5) -> DataFrame:
    """One row: drafts, mean gain of looking ahead and its standard error, share of punished first picks and of actual picks among the policy's first ``k``."""
    gain = F.col("plied_p") - F.col("greedy_p")
    share = lambda c: F.avg(c.cast("int"))
    hit = lambda c: F.avg(F.when(F.col(c) > 0, (F.col(c) <= k).cast("int")))
    return done.agg(
        F.count(F.lit(1)).alias("n"), F.avg(gain).alias("uplift"), (F.stddev_samp(gain) / F.sqrt(F.count(F.lit(1)))).alias("error"),
        share(F.col("greedy_punished")).alias("greedy_punished"), share(F.col("plied_punished")).alias("plied_punished"), hit("actual_greedy").alias("greedy_agrees"), hit("actual_plied").alias("plied_agrees"),
    )
