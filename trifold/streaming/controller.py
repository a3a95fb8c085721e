"""The adaptive poll controller: a fold over each key's polls, in batch and as a stream.

State per key: poll interval, empty polls in a row, whether it is active, whether it was ever polled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trifold.session import durable, small

#: Seconds: shortest, longest and first interval.  Counts: what fills a source's window, and what comes near.
SHORTEST, LONGEST, FIRST, FULL, NEAR, SPARSE, PATIENCE = 900, 1_209_600, 3600, 22, 15, 2, 6


def step(interval: int, empties: int, new: int, first: bool) -> tuple[int, int, bool, bool, str]:
    """The next interval, empties, whether active, whether records were probably lost, and why."""
    loss = False
    if new >= FULL:
        factor, why, loss = 0.5, "first_poll_backfill" if first else "suspected_loss", not first
    elif new >= NEAR:
        factor, why = 0.8, "approaching_capacity"
    elif new == 0:
        factor, why = 2.0, "empty"
    elif new <= SPARSE:
        factor, why = 1.5, "sparse"
    else:
        factor, why = 1.0, "in_band"
    empties = empties + 1 if new == 0 else 0
    interval = int(min(LONGEST, max(SHORTEST, interval * factor + 0.5)))
    return interval, empties, empties <= PATIENCE, loss, why


#: Of the activity, what stays of the old value; the shortest and the first poll's hours since the one before.
KEPT, LEAST_HOURS, FIRST_HOURS = 0.7, 0.25, 1.0


def decayed(activity: float, new: int, seconds: float | None) -> float:
    """Matches a day, averaged over polls; seconds since the poll before, None at the first one."""
    hours = FIRST_HOURS if seconds is None else max(seconds / 3600, LEAST_HOURS)
    return KEPT * activity + (1 - KEPT) * (new / hours * 24)


#: A tag of more polls than this isn't folded as one array.
MOST = 1_000_000
FIELDS = "polls int, interval bigint, empties int, losses int, active boolean, activity double, last_poll bigint"
#: polls, interval, empties, losses, activity and last poll of a tag before its first one.
START = (0, FIRST, 0, 0, 0.0, None)


def advance(state: tuple, polls: list[tuple]) -> tuple:
    """The state after polls (epoch, event_id, new matches) in order."""
    n, interval, empties, losses, activity, last = state
    for epoch, _, new in polls:
        interval, empties, _, loss, _ = step(interval, empties, new, n == 0)
        activity = decayed(activity, new, None if last is None else epoch - last)
        n, losses, last = n + 1, losses + int(loss), epoch
    return n, interval, empties, losses, activity, last


def _row(state: tuple) -> tuple:
    n, interval, empties, losses, activity, last = state
    return n, interval, empties, losses, empties <= PATIENCE, activity, last


def known(polls: DataFrame) -> DataFrame:
    """Polls that count: those with a time and a number of new matches; a failed one has none and changes nothing."""
    rows = polls.where(F.col("epoch").isNotNull() & F.col("new_matches").isNotNull())
    return rows.select("tag", F.col("epoch").cast("long").alias("epoch"), F.col("event_id").cast("long").alias("event_id"), F.col("new_matches").cast("int").alias("new_matches"))


def _schema(polls: DataFrame) -> str:
    return f"tag {dict(polls.dtypes)['tag']}, {FIELDS}"


def fold(polls: DataFrame, most: int = MOST) -> DataFrame:
    """polls: tag (of any type that can be a key), epoch, event_id, new_matches.  The state of each tag after all its polls.

    A tag's polls are folded in order; tags are the unit of work.  Those of up
    to ``most`` polls are folded in JVM expressions; the others stream through
    their task in order, sorted on disk if need be, so none is held whole.  Polls
    without a time or a number of matches change nothing; a null tag is one like
    any other."""
    polls = known(polls)
    large = durable(polls.groupBy(F.col("tag").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("of"))
    if not large.count():
        return _fold_arrays(polls)
    large = small(large)
    same = F.col("tag").eqNullSafe(F.col("of"))
    rows = polls.join(large, same, "left_semi")
    hot = rows.repartition("tag").sortWithinPartitions("tag", "epoch", "event_id", "new_matches").mapInArrow(_fold_sorted, _schema(polls))
    return _fold_arrays(polls.join(large, same, "left_anti")).unionByName(hot)


def _fold_sorted(batches):
    """The end state of each tag; rows in order of tag and time, of which a tag may fill many batches."""
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.int64()]
    tag, state = None, None

    def row(kind):
        values = zip(_row(state), types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([tag], kind), *[pa.array([x], t) for x, t in values]], names=["tag", *[f.split()[0] for f in FIELDS.split(", ")]])

    for batch in batches:
        kind = batch.column("tag").type
        for t, *poll in zip(*(batch.column(c).to_pylist() for c in ("tag", "epoch", "event_id", "new_matches")), strict=True):
            if state is None or t != tag:
                if state is not None:
                    yield row(kind)
                tag, state = t, START
            state = advance(state, [poll])
    if state is not None:
        yield row(kind)


def _fold_arrays(polls: DataFrame) -> DataFrame:
    rows = polls.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("epoch", "event_id", "new_matches"))).alias("ps"))
    start = F.struct(F.lit(FIRST).cast("long").alias("i"), F.lit(0).alias("e"), F.lit(0).alias("losses"), F.lit(0.0).alias("a"), F.lit(None).cast("long").alias("t"))

    def one(acc, p):
        n = p["new_matches"]
        factor = F.when(n >= FULL, 0.5).when(n >= NEAR, 0.8).when(n == 0, 2.0).when(n <= SPARSE, 1.5).otherwise(1.0)
        interval = F.floor(F.least(F.lit(float(LONGEST)), F.greatest(F.lit(float(SHORTEST)), acc["i"] * factor + 0.5)))
        hours = F.when(acc["t"].isNull(), FIRST_HOURS).otherwise(F.greatest((p["epoch"] - acc["t"]) / 3600, F.lit(LEAST_HOURS)))
        return F.struct(
            interval.cast("long").alias("i"),
            F.when(n == 0, acc["e"] + 1).otherwise(0).alias("e"),
            (acc["losses"] + ((n >= FULL) & acc["t"].isNotNull()).cast("int")).alias("losses"),
            (acc["a"] * KEPT + (n / hours * 24) * (1 - KEPT)).alias("a"),
            p["epoch"].alias("t"),
        )

    rows = rows.withColumn("end", F.aggregate("ps", start, one))
    return rows.select("tag", F.size("ps").alias("polls"), F.col("end.i").alias("interval"), F.col("end.e").alias("empties"), F.col("end.losses").alias("losses"), (F.col("end.e") <= PATIENCE).alias("active"), F.col("end.a").alias("activity"), F.col("end.t").alias("last_poll"))


class Polls(StatefulProcessor):
    """Each tag's settled state, and its polls that later ones may still precede.

    Polls wait until the watermark has passed them and are then folded in order,
    so what arrives late, within the watermark, is folded in its place.  Each call
    gives the state as it will be if nothing comes in between (event ``state``); a
    timer gives a row (event ``due``) once the next poll's time has come."""

    SETTLED = "polls int, interval bigint, empties int, losses int, activity double, last_poll bigint"
    WAITING = "epoch array<bigint>, event_id array<bigint>, new_matches array<int>"  # one value a tag: a list state's items are sent one by one
    NAMES = ("tag", *[f.split()[0] for f in FIELDS.split(", ")], "event", "due_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", self.SETTLED)
        self.waiting = handle.getValueState("waiting", self.WAITING)

    def _waiting(self) -> list[tuple]:
        return list(zip(*(self.waiting.get() or ()), strict=True))

    def _out(self, key, state: tuple, event: str) -> Row:
        return Row(**dict(zip(self.NAMES, (key[0], *_row(state), event, int(state[5] + state[1])), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        settled, polls = self.settled.get(), self._waiting()
        met = settled is not None or bool(polls)
        polls.extend(tuple(r[1:4]) for r in rows)  # by place, as ``known`` has them: names are looked up row by row
        polls.sort(key=lambda p: (p[0], p[1] is not None, p[1] or 0, p[2]))
        over = bisect_right(polls, mark, key=lambda p: p[0])
        state = tuple(settled or START)
        if over:
            state = advance(state, polls[:over])
            self.settled.update(state)
        rest = polls[over:]
        if rest:
            self.waiting.update(tuple(map(list, zip(*rest, strict=True))))
        elif met:
            self.waiting.clear()
        state = advance(state, rest)
        if met:  # a tag that is met for the first time has no timer
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
        if state[2] <= PATIENCE:
            self.handle.registerTimer((state[5] + state[1]) * 1000)
        yield self._out(key, state, "state")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._out(key, advance(tuple(self.settled.get() or START), self._waiting()), "due")

    def close(self) -> None:
        pass


def stream(polls: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a streaming frame: a row of event ``state`` for each tag that a batch touches, and of event ``due`` when its next poll's time has come.

    A poll may come ``late`` by so much; later ones are dropped.  State is kept in
    RocksDB; ``plans.streams.run`` sets that."""
    rows = known(polls).withColumn("at", F.timestamp_seconds("epoch")).withWatermark("at", late)
    return rows.groupBy("tag").transformWithState(Polls(), f"{_schema(polls)}, event string, due_at bigint", "update", "eventTime")


def first_seen(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stream deduplication by content key: the least observation by ``order`` of each key, told again when an earlier one arrives.

    The latest row that a key got is its first observation in time, however they
    arrive; keys are remembered for good, one row each."""
    return observations.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in order])
