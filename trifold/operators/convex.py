"""Minimisation of sums over distributed rows, with linear equality constraints.

The parameters are a vector in the driver; the rows stay where they are.  Each
evaluation sends the vector out, and every task adds up its rows' loss and
gradient in Arrow batches; the sums come back through a tree, so the driver never
gets more than FAN of them.  Steps are those of L-BFGS on the null space of the
constraints: gradients are projected onto it, so a point that satisfies the
constraints goes on to do so, and a step ends by the norm of the projected
gradient, not by a number of iterations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums that one task of the tree, or the driver, takes at most.
FAN = 64
#: Pairs that L-BFGS remembers; what a step has to gain, and how far a slope has to fall.
MEMORY, GAIN, SLOPE = 20, 1e-4, 0.9
#: Values that differ by a smaller share count as equal: near the end rounding hides what a step gains, and slopes decide.
NOISE = 1e-13
SUMS = "part int, sums binary"


def _emit(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def _added(batches):
    """Sums of one part to a single one; rows in order of parts."""
    part, total = None, None
    for batch in batches:
        for p, b in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if p != part:
                if part is not None:
                    yield _emit(part // FAN, total)
                part, total = p, np.zeros(len(b) // 8)
            total += np.frombuffer(b)
    if part is not None:
        yield _emit(part // FAN, total)


def sums(rows: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray], parts: int | None = None) -> np.ndarray:
    """The sum over all batches of ``of(batch)``, a vector of ``size`` numbers; ``parts``: how many partitions the rows have."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield _emit(TaskContext.get().partitionId() // FAN, total)

    out = rows.mapInArrow(run, SUMS)
    n = parts if parts is not None else rows.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        out = out.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_added, SUMS)
    return np.sum([np.frombuffer(r["sums"]) for r in out.collect()], axis=0) if n else np.zeros(size)


class Constraints:
    """matrix @ x = 0; few rows, as many columns as parameters."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.asarray(matrix, float)
        self.inverse = np.linalg.pinv(self.matrix @ self.matrix.T)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x - self.matrix.T @ (self.inverse @ (self.matrix @ x))


class Found:
    """x, the value there, the largest entry of the projected gradient, steps and evaluations, and whether it is below the tolerance."""

    def __init__(self, x: np.ndarray, value: float, gradient: float, steps: int, evaluations: int, converged: bool):
        self.x, self.value, self.gradient, self.steps, self.evaluations, self.converged = x, value, gradient, steps, evaluations, converged


def _direction(gradient: np.ndarray, memory: deque, scaled: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The two loops of L-BFGS around ``scaled``, its first guess; all vectors lie in the null space, and so does the result."""
    q, alphas = gradient.copy(), []
    for s, y in reversed(memory):
        a = (s @ q) / (s @ y)
        alphas.append(a)
        q -= a * y
    q = scaled(q)
    if memory:
        s, y = memory[-1]
        q *= (s @ y) / (y @ scaled(y))
    for (s, y), a in zip(memory, reversed(alphas), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def _search(evaluate, x, value, slope, direction, step):
    """A step by bisection that gains enough and leaves a small slope, or the best one there is: x, value, gradient and evaluations."""
    low, high, best, noise = 0.0, np.inf, None, NOISE * max(abs(value), 1e-300)
    for n in range(1, 31):
        at = x + step * direction
        new, gradient = evaluate(at)
        if not np.isfinite(new) or new > value + GAIN * step * slope + noise:
            high = step
        else:
            if best is None or new <= best[1] + noise:
                best = at, new, gradient
            if gradient @ direction >= SLOPE * slope:
                return *best, n
            low = step
        step = (low + high) / 2 if np.isfinite(high) else 2 * low
        if best is not None and high - low < 1e-12 * max(high, 1):
            break
    return (*best, n) if best is not None else (None, value, None, n)


def minimise(
    objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, constraints: Constraints | None = None, most: int = 500, curvature: np.ndarray | Callable[[np.ndarray], np.ndarray] | None = None
) -> Found:
    """The least value of ``objective`` (x -> value and gradient) under the constraints, from ``start`` projected onto them.

    ``curvature`` is about how much each parameter's own second derivative is, or what solves
    for a gradient by about the second derivatives: steps are scaled by it, which saves many
    where parameters are met far more or less often, or always together.
    It stops once no entry of the projected gradient is over ``tolerance``, or when
    no step along the gradient gains anything any more; ``most`` steps are a guard,
    and ``converged`` says which it was."""
    project = constraints.project if constraints else (lambda v: v)
    solve = curvature if callable(curvature) else (lambda v: v / curvature)
    scaled = (lambda v: v.copy()) if curvature is None else (lambda v: project(solve(project(v))))

    def evaluate(v):
        value, gradient = objective(v)
        return value, project(gradient)

    x = project(np.asarray(start, float))
    value, gradient = evaluate(x)
    evaluations, memory, steps = 1, deque(maxlen=MEMORY), 0
    while steps < most and np.abs(gradient).max(initial=0.0) > tolerance:
        direction = _direction(gradient, memory, scaled)
        slope = gradient @ direction
        if slope >= 0:
            memory.clear()
            direction = -scaled(gradient)
            slope = gradient @ direction
        first = 1.0 if memory or curvature is not None else 1 / np.linalg.norm(gradient)  # without either, a move of length 1 is tried
        at, new, after, n = _search(evaluate, x, value, slope, direction, first)
        evaluations += n
        if at is None:
            if not memory:
                break
            memory.clear()
            continue
        at = project(at)  # takes off what rounding adds
        moved, change = at - x, after - gradient
        if moved @ change > 1e-12 * (change @ change):
            memory.append((moved, change))
        x, value, gradient, steps = at, new, after, steps + 1
    left = float(np.abs(gradient).max(initial=0.0))
    return Found(x, value, left, steps, evaluations, left <= tolerance)


def logistic_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss of scores z, and its derivative by each of them."""
    loss = np.logaddexp(0, z) - y * z
    return float(w @ loss), w * (np.exp(-np.logaddexp(0, -z)) - y)


#: Rows of a design that ``pack`` makes one of; entries that an evaluation takes at once, which a core's cache holds.
PACK, TAKEN = 16, 1 << 16
PACKED = "names array<string>, sizes binary, y binary, w binary, offset binary, number binary, code binary, value binary"
#: The code of a value that isn't a whole number of a byte, and stands by itself.
OTHER = -128


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values' bytes, cut at these places."""
    at = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind) -> np.ndarray:
    """The numbers of a column of their bytes, of all its rows."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1] if at and len(column) else [0, 0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if at[-1] > at[0] else np.zeros(0, kind)


def pack(y, w, offset, sizes, number, value, n: int, names: list[str] | None = None) -> pa.RecordBatch:
    """Rows of a design with numbers below ``n``, PACK of them as one of bytes, so that what isn't Python only copies them; ``names``, if given, stand in the first."""
    cuts = np.append(np.arange(0, len(sizes), PACK), len(sizes))
    inner = np.append(0, np.cumsum(sizes))[cuts]
    value = np.asarray(value, float)
    whole = (np.abs(value) < -OTHER) & (value == np.rint(value))
    code = np.where(whole, value, OTHER).astype(np.int8)
    others = np.append(0, np.cumsum(~whole))[inner]
    first = pa.array([names, *[None] * (len(cuts) - 2)], pa.list_(pa.string()))
    own = [_binary(np.asarray(x, kind), cuts) for x, kind in ((sizes, np.int32), (y, float), (w, float), (offset, float))]
    entries = _binary(np.asarray(number, np.uint16 if n <= 1 << 16 else np.int32), inner), _binary(code, inner), _binary(value[~whole], others)
    return pa.RecordBatch.from_arrays([first, *own, *entries], names=["names", "sizes", "y", "w", "offset", "number", "code", "value"])


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    of = lambda c, kind: _values(batch.column(c), kind)
    code, number = of("code", np.int8), of("number", np.uint8)
    return of("y", float), of("w", float), of("offset", float), of("sizes", np.int32), number.view(np.uint16 if len(number) == 2 * len(code) else np.int32), code, of("value", float)


def _decoded(code: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the codes, and what is left of those that stand by themselves."""
    value = code.astype(float)
    if not len(others):
        return value, others
    at = np.flatnonzero(code == OTHER)
    value[at] = others[: len(at)]
    return value, others[len(at) :]


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """y, weight, offset and number of entries of each packed row, and number and value of all entries."""
    *own, number, code, others = _packed(batch)
    return *own, number, _decoded(code, others)[0]


def _design(batch: pa.RecordBatch, beta: np.ndarray):
    """Row, number and value of the entries, and each row's score, y and weight, of TAKEN entries or the rows of one at a time; rows are packed or have lists."""
    if packed := "sizes" in batch.schema.names:
        y, w, offset, sizes, number, value, others = _packed(batch)
    else:
        y, w, offset = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "offset"))
        number, value = (batch.column(c) for c in ("number", "value"))
        sizes, number, value = np.diff(number.offsets.to_numpy()), number.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    a, done = 0, 0
    while a < len(sizes):
        b = max(int(np.searchsorted(ends, done + TAKEN, side="right")), a + 1)
        row, k, v = np.repeat(np.arange(b - a), sizes[a:b]), number[done : ends[b - 1]], value[done : ends[b - 1]]
        if packed:
            v, others = _decoded(v, others)
        yield row, k, v, offset[a:b] + np.bincount(row, v * beta[k], minlength=b - a), y[a:b], w[a:b]
        a, done = b, int(ends[b - 1])


def logistic(rows: DataFrame, size: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """The log loss over rows (y, w, offset, number array<int>, value array<double>), or packed ones, and its gradient, as a function of the parameters.

    y may lie between 0 and 1: the mean of the w matches that a row stands for."""
    context, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()

    def objective(beta: np.ndarray) -> tuple[float, np.ndarray]:
        held = context.broadcast(beta)

        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(size + 1)
            for row, number, value, z, y, w in _design(batch, held.value):
                loss, slope = logistic_loss(z, y, w)
                total[:-1] += np.bincount(number, slope[row] * value, minlength=size)
                total[-1] += loss
            return total

        total = sums(rows, size + 1, of, parts)
        held.unpersist()
        return float(total[-1]), total[:-1]

    return objective


def logistic_curvature(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """The diagonal of the second derivatives of ``logistic`` at ``beta``."""
    held = rows.sparkSession.sparkContext.broadcast(beta)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(len(held.value))
        for row, number, value, z, _, w in _design(batch, held.value):
            p = np.exp(-np.logaddexp(0, -z))
            total += np.bincount(number, (w * p * (1 - p))[row] * value * value, minlength=len(total))
        return total

    total = sums(rows, len(beta), of)
    held.unpersist()
    return total


#: Entries whose pairs are counted at once.
PAIRED = 1 << 16


def logistic_block(rows: DataFrame, beta: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The second derivatives of ``logistic`` at ``beta`` by all pairs of the ``chosen`` parameters, a matrix."""
    m = len(chosen)
    place = np.full(len(beta), -1)
    place[chosen] = np.arange(m)
    held, upper = rows.sparkSession.sparkContext.broadcast((beta, place)), np.triu_indices(m)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        beta, place = held.value
        total = np.zeros(m * m)
        for row, number, value, z, _, w in _design(batch, beta):
            p = np.exp(-np.logaddexp(0, -z))
            known = place[number] >= 0
            row, at, value = row[known], place[number[known]], value[known]
            weighted = value * (w * p * (1 - p))[row]
            first = np.searchsorted(row, np.arange(len(z) + 1))
            many = np.diff(first)[row]
            for a in range(0, len(row), PAIRED):
                n = many[a : a + PAIRED]
                one = np.repeat(np.arange(a, a + len(n)), n)
                other = first[row[one]] + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
                total += np.bincount(at[one] * m + at[other], weighted[one] * value[other], minlength=m * m)
        return total.reshape(m, m)[np.triu_indices(m)]

    out = np.zeros((m, m))
    out[upper] = sums(rows, len(upper[0]), of)
    held.unpersist()
    return out + np.triu(out, 1).T


def spread(rows: DataFrame, n: int, a_part: int) -> DataFrame:
    """Rows in as many parts as there is work for, so that each evaluation keeps all tasks busy."""
    return rows.repartition(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // a_part + 1))


def total_weight(rows: DataFrame) -> float:
    return rows.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
