"""Low-rank pair effects: z adds u_i' S u_j over allies i, j and u_i' C u_j for i against j.

S is symmetric and C antisymmetric by construction: S is the symmetric part of a
free matrix, C the antisymmetric part of another, so exchanging the teams changes
every sign.  Scores need the two tables U S U' and U C U' only, and the loss depends
on them through sums over pairs, so a pass over the drafts adds up, for each
ordered pair, the loss's derivative by its table entry; gradients of strengths, U, S
and C follow from these sums in the driver.  ``convex.minimise`` moves all of them
together and a fit ends by the gradient's norm, not by a number of steps: steps that
held U and the rest in turn had not settled after a thousand passes.

Limits: the tables have n_ids^2 entries, of which every task holds a copy, and up to
MOST characters are taken.  The whole problem isn't convex, so what is found is a
stationary point that depends on the seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trifold.functions.expr import sigmoid
from trifold.operators import convex
from trifold.operators.fit import ROWS_A_PART, alike
from trifold.session import durable
from trifold.sources.bind import N

MOST = 1000
#: Penalties of a strength, of a factor's entry and of a form's entry; the size of first factors.
SOLO, FACTOR, FORM, FIRST = 5.0, 1.0, 1.0, 0.3
#: L-BFGS steps of a round; steps that are an error if a fit hasn't ended by then; when it ends: entries of the mean objective's gradient.
#: Many matches with weak effects have gradients of 1e-6 at the saddle without any pair effects, too.
STEPS, GUARD, TOLERANCE = 12, 20_000, 1e-7


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def antisymmetric(m: np.ndarray) -> np.ndarray:
    return (m - m.T) / 2


class Factors:
    """Strengths, factors (a row for each character) and the two forms."""

    def __init__(self, solo: np.ndarray, u: np.ndarray, s: np.ndarray, c: np.ndarray, value: float = np.nan, passes: int = 0):
        self.solo, self.u, self.s, self.c, self.value, self.passes = solo, u, s, c, value, passes

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What allies i, j add, and what i adds against j."""
        return self.u @ self.s @ self.u.T, self.u @ self.c @ self.u.T

    def predict(self, drafts: DataFrame) -> DataFrame:
        """``drafts`` with z and p, in place of columns of these names."""
        held = drafts.sparkSession.sparkContext.broadcast((self.solo, *self.tables))
        rows = drafts.drop("z", "p")

        def run(batches):
            for batch in batches:
                z = scores(*held.value, *teams(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=[*batch.schema.names, "z"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("z", DoubleType())])).withColumn("p", sigmoid("z"))


def teams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The picks of both teams, a row for each draft; teams are of one size."""
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return tuple(flat(c).reshape(batch.num_rows, -1) for c in ("a", "b"))


def _allies(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(t.shape[1], 1)
    return t[:, i], t[:, j]


def scores(solo, ally, against, a, b) -> np.ndarray:
    z = solo[a].sum(axis=1) - solo[b].sum(axis=1)
    for t, sign in ((a, 1), (b, -1)):
        i, j = _allies(t)
        z += sign * ally[i, j].sum(axis=1)
    return z + against[a[:, :, None], b[:, None, :]].sum(axis=(1, 2))


def _losses(rows: DataFrame, n: int):
    """Log loss and its derivatives by strengths and by the entries of both tables, as a function of these; a row stands for w matches with the mean y."""
    rows = rows if "w" in rows.columns else rows.withColumn("w", F.lit(1.0))
    context, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()

    def losses(solo, ally, against):
        held = context.broadcast((solo, ally, against))

        def of(batch: pa.RecordBatch) -> np.ndarray:
            a, b = teams(batch)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
            loss, slope = convex.logistic_loss(scores(*held.value, a, b), y, w)
            count = lambda index, weight, size: np.bincount(index.ravel(), np.broadcast_to(weight, index.shape).ravel(), minlength=size)
            s = slope[:, None]
            own = count(a, s, n) - count(b, s, n)
            (i, j), (k, m) = _allies(a), _allies(b)
            pair = count(i * n + j, s, n * n) - count(k * n + m, s, n * n)
            versus = count(a[:, :, None] * n + b[:, None, :], slope[:, None, None], n * n)
            return np.concatenate([[loss], own, pair, versus])

        total = convex.sums(rows, 1 + n + 2 * n * n, of, parts)
        held.unpersist()
        return total[0], total[1 : 1 + n], total[1 + n : 1 + n + n * n].reshape(n, n), total[1 + n + n * n :].reshape(n, n)

    return losses


def fit(drafts: DataFrame, k: int, n_ids: int = N, seed: int = 7, rounds: int | None = None, weight: str | None = None) -> Factors:
    """Factors of rank ``k`` from y, a and b of decided drafts, whose picks are numbers below ``n_ids``; ``weight`` names a column of case weights.

    ``rounds``, if given, ends it after so many rounds of STEPS steps, settled or not."""
    if n_ids > MOST:
        raise ValueError(f"{n_ids} characters; at most {MOST} have tables")
    # Matches of the same teams are one row.
    cells = durable(alike(drafts.withColumns({c: F.col(c).cast("array<int>") for c in ("a", "b")}), [], weight).select("y", "w", "a", "b"))
    rows = durable(convex.spread(cells, cells.count(), ROWS_A_PART))
    losses, n, passes = _losses(rows, n_ids), max(convex.total_weight(rows), 1), 0
    rng = np.random.default_rng(seed)
    solo, u, s, c = np.zeros(n_ids), rng.normal(0, FIRST, (n_ids, k)), symmetric(rng.normal(0, 0.1, (k, k))), antisymmetric(rng.normal(0, 0.1, (k, k)))

    def whole(solo, u, s, c):
        """Mean objective and its gradient by each part."""
        nonlocal passes
        passes += 1
        loss, own, pair, versus = losses(solo, u @ s @ u.T, u @ c @ u.T)
        value = loss + SOLO / 2 * solo @ solo + FACTOR / 2 * (u**2).sum() + FORM / 2 * ((s**2).sum() + (c**2).sum())
        by_u = pair @ u @ s.T + pair.T @ u @ s + versus @ u @ c.T + versus.T @ u @ c + FACTOR * u
        return value / n, (own + SOLO * solo) / n, by_u / n, (symmetric(u.T @ pair @ u) + FORM * s) / n, (antisymmetric(u.T @ versus @ u) + FORM * c) / n

    cuts = np.cumsum([n_ids, n_ids * k, k * k])

    def parts(x):
        solo, u, s, c = np.split(x, cuts)
        return solo, u.reshape(n_ids, k), symmetric(s.reshape(k, k)), antisymmetric(c.reshape(k, k))

    def objective(x):
        value, *by = whole(*parts(x))
        return value, np.concatenate([g.ravel() for g in by])

    found = convex.minimise(objective, np.concatenate([x.ravel() for x in (solo, u, s, c)]), TOLERANCE, most=GUARD if rounds is None else rounds * STEPS)
    if rounds is None and not found.converged:
        raise RuntimeError(f"the fit of rank {k} stopped after {found.steps} steps with a gradient of {found.gradient:.2g}")
    return Factors(*parts(found.x), found.value, passes)
