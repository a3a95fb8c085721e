"""Penalised logistic fits: sum of losses + sum over k of penalty_k / 2 * beta_k^2, without intercept
but for the family that is one.

Coefficients are fitted as beta_k * sqrt(penalty_k), which all have the penalty 1,
by ``convex.minimise``.  Matches that agree in all that the families read are one row
with their number and mean result, so a step costs as much as there are different
ones.  The design stays distributed as sparse rows, made within each such row; only the
parameters come to the driver, where the optimiser keeps them anyway."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trifold.functions.expr import sigmoid
from trifold.operators import convex, design
from trifold.session import durable
from trifold.sources.bind import N

#: Penalty by the first part of a feature's name.
PENALTY = {
    "solo": 5.0, "solo_mode": 15.0, "solo_map": 40.0, "solo_patch": 30.0, "solo_tier": 40.0, "solo_hour": 40.0, "syn": 60.0, "ctr": 60.0, "ctr_mode": 120.0,
    "theory": 5.0, "role": 5.0, "matchup": 5.0, "matchup_mode": 15.0, "stack": 2.0, "structure": 5.0, "popularity": 1.0, "power": 1.0, "mastery": 1.0,
}
#: The first part of a family's features' names, where it isn't the family's name.
BLOCKS = {"synergy": "syn", "counter": "ctr", "counter_mode": "ctr_mode", "roles": "role"}
#: The one feature that is the same for all matches: it is an intercept, without a penalty.
SIDE = "side:"
#: Largest entry of the mean objective's gradient, by beta * sqrt(penalty), that a fit may stop at.  That objective curves by 1 / total
#: weight at least, so a beta is off by total weight * (norm of the gradient) / sqrt(penalty) at most.
TOLERANCE = 1e-7
#: Rows that are worth a task of their own.
ROWS_A_PART = 10_000


class Model:
    """Feature names in order and their coefficients; ``gradient`` is the largest entry left, ``iterations`` the steps taken."""

    def __init__(self, spark: SparkSession, names: list[str], beta: np.ndarray, families: list[str], gradient: float = 0.0, iterations: int = 0):
        self.spark, self.names, self.beta, self.families, self.gradient, self.iterations = spark, names, np.asarray(beta, float), families, gradient, iterations

    @property
    def coefficients(self) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.names, self.beta.tolist(), strict=True)), "feature string, beta double")

    def predict(self, drafts: DataFrame) -> DataFrame:
        """``drafts`` with z and p, in place of columns of these names; features that were not fitted count nothing."""
        held = drafts.sparkSession.sparkContext.broadcast((pa.array(self.names, pa.string()), self.beta))
        drafts = drafts.drop("z", "p")
        rows = drafts.withColumn("_e", design.entries(self.families))
        schema = StructType([*drafts.schema.fields, StructField("z", DoubleType())])
        return rows.mapInArrow(_scores(held), schema).withColumn("p", sigmoid("z"))


def _entries(column: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature number and value of each known entry of an array<struct<feature,value>> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    number = pc.fill_null(pc.index_in(flat.field("feature").cast(pa.string()), value_set=names), -1).to_numpy()
    value = flat.field("value").to_numpy(zero_copy_only=False)
    known = (number >= 0) & (value != 0)
    return row[known], number[known].astype(np.int64), value[known]


def _scores(held):
    def run(batches):
        names, beta = held.value
        for batch in batches:
            k = batch.schema.get_field_index("_e")
            row, number, value = _entries(batch.column(k), names)
            z = np.bincount(row, value * beta[number], minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows)
            columns = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(z)], names=[*(n for n in batch.schema.names if n != "_e"), "z"])

    return run


def _coded(batches):
    """Packed rows of y, w, offset and entries e: a batch's features are numbered in the order of the names in its first packed row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column("e").flatten()
        features = pc.dictionary_encode(flat.field("feature").cast(pa.string()))
        number = pc.fill_null(features.indices, -1).to_numpy().astype(np.int64)
        value = flat.field("value").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("e")), 0).to_numpy())
        known = (number >= 0) & (value != 0)
        row, number, value = row[known], number[known], value[known]
        seen = np.unique(number)
        number = np.searchsorted(seen, number)
        order = np.argsort(row * max(len(seen), 1) + number, kind="stable")
        row, number, value = row[order], number[order], value[order]
        new = np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])) if len(row) else np.zeros(0, bool)
        value = np.add.reduceat(value, np.flatnonzero(new)) if len(row) else value
        sizes = np.bincount(row[new], minlength=batch.num_rows)
        own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "offset"))
        yield convex.pack(*own, sizes, number[new], value, len(seen), features.dictionary.take(pa.array(seen)).to_pylist())


def _numbered(held):
    """Packed rows with the numbers of the held names in place of a batch's own; entries of other features are left out."""

    def run(batches):
        names, places = held.value, np.zeros(0, np.int64)
        for batch in batches:
            given = batch.column("names")
            cuts = [*np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            for a, b in zip([0, *cuts], cuts, strict=False):
                if a == b:
                    continue
                if given[a].is_valid:
                    places = pc.fill_null(pc.index_in(pa.array(given[a].as_py(), pa.string()), value_set=names), -1).to_numpy().astype(np.int64)
                y, w, offset, sizes, number, value = convex.unpack(batch.slice(a, b - a))
                number = places[number]
                known = number >= 0
                row = np.repeat(np.arange(len(sizes)), sizes)[known]
                yield convex.pack(y, w, offset, np.bincount(row, minlength=len(sizes)), number[known], value[known], len(names))

    return run


def _listed(batches):
    for batch in batches:
        y, w, offset, sizes, number, value = convex.unpack(batch)
        at = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (y, w, offset)), *lists], names=["y", "w", "offset", "number", "value"])


def pair_places(names: list[str], block: str) -> list[tuple[int, int, int]]:
    """Place, lower and higher character of each pair feature of a block."""
    start = [i * (2 * N - i - 1) // 2 for i in range(N)]
    out = []
    for k, name in enumerate(names):
        if name.startswith(f"{block}:"):
            at = int(name.split(":")[1])
            i = int(np.searchsorted(start, at, side="right")) - 1
            while at - start[i] >= N - i - 1:  # the last character begins no pair
                i -= 1
            out.append((k, i, at - start[i] + i + 1))
    return out


def row_sums(names: list[str]) -> np.ndarray:
    """A row for each character and pair block (synergy, counter): its pairs' coefficients, as they count for it, add up to 0."""
    rows: dict[tuple[str, int], np.ndarray] = {}
    for block, sign in (("syn", 1.0), ("ctr", -1.0)):
        for k, i, j in pair_places(names, block):
            for who, value in ((i, 1.0), (j, sign)):
                rows.setdefault((block, who), np.zeros(len(names)))[k] = value
    return np.array([rows[key] for key in sorted(rows)]).reshape(-1, len(names))


def alike(drafts: DataFrame, families: list[str], weight: str | None = None, offset: str | None = None) -> DataFrame:
    """A row for all matches that the families cannot tell apart: what they read, offset, the sum w of their weights and the weighted mean y.

    The log loss is linear in y, so sums over these rows are those over the matches."""
    keys = {**design.reads(families), "offset": (F.col(offset) if offset else F.lit(0.0)).cast("double")}
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    rows = drafts.select(*[c.alias(k) for k, c in keys.items()], w.alias("_w"), F.col("y").cast("double").alias("_y"))
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("_won"))
    return sums.select(*keys, "w", F.coalesce(F.try_divide("_won", "w"), F.lit(0.0)).alias("y"))


class Prepared:
    """The rows of a fit, made once for any penalties and starts: ``cells`` as by ``alike``, the ``names`` of the features that
    they have, ``packed`` with each row's feature numbers and values, and the ``total`` weight.

    Entries are made once for all families and numbered; ``within`` has the rows of some of the families."""

    def __init__(self, cells: DataFrame, families: list[str], whole: Prepared | None = None):
        self.cells, self.families = cells, families
        if whole is None:
            rows = convex.spread(cells, cells.count(), ROWS_A_PART).select("y", "w", "offset", design.entries(families).alias("e"))
            self.coded = durable(rows.mapInArrow(_coded, convex.PACKED))
            self.seen = sorted(r[0] for r in self.coded.select(F.explode("names")).distinct().collect())  # the parameters, not the rows
            weight = convex.total_weight(cells)
        else:
            self.coded, self.seen, weight = whole.coded, whole.seen, whole.weight
        blocks, self.weight = {BLOCKS.get(f, f) for f in families}, weight
        names = [f for f in self.seen if f.split(":", 1)[0] in blocks]
        self.names = [f for f in names if f != SIDE] + [f for f in names if f == SIDE]
        self.packed, self.total = None, 0.0
        if names:
            held = cells.sparkSession.sparkContext.broadcast(pa.array(self.names, pa.string()))
            self.packed, self.total = durable(self.coded.mapInArrow(_numbered(held), convex.PACKED)), weight

    def within(self, families: list[str]) -> Prepared:
        """What a fit on these families takes, which are some of those that the rows were made for."""
        return Prepared(self.cells, families, self)

    @property
    def data(self) -> DataFrame | None:
        """``packed`` with a row for each of the cells, and lists."""
        lists = "y double, w double, offset double, number array<int>, value array<double>"
        return self.packed.mapInArrow(_listed, lists) if self.packed is not None else None


def prepare(drafts: DataFrame, families: list[str], weight: str | None = None, offset: str | None = None) -> Prepared:
    """What ``fit`` takes in place of drafts, where it is called more than once for the same rows and families."""
    return Prepared(durable(alike(drafts, families, weight, offset)), families)


def fit(
    drafts: DataFrame | Prepared, families: list[str], penalty: dict[str, float] | None = None, weight: str | None = None, iterations: int = 1000, offset: str | None = None, constrained: bool = False, start: Model | None = None
) -> Model:
    """Fits y of decided drafts on the families; ``weight`` names a column of case weights, ``offset`` one that is added to z as it is.

    ``constrained`` holds the row sums of pair blocks at 0; ``start`` is a model whose coefficients the fit begins with."""
    penalty = PENALTY | (penalty or {})
    made = drafts if isinstance(drafts, Prepared) else prepare(drafts, families, weight, offset)
    spark, names, data, total = made.cells.sparkSession, made.names, made.packed, made.total
    if not total:
        return Model(spark, names, np.zeros(len(names)), families)
    own = np.array([f != SIDE for f in names], float)
    scales = np.array([1 / math.sqrt(penalty[f.split(":", 1)[0]]) if f != SIDE else 1.0 for f in names])
    losses = convex.logistic(data, len(names))

    def objective(u: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = losses(u * scales)
        return (value + (own * u) @ u / 2) / total, (gradient * scales + own * u) / total

    matrix = row_sums(names) * scales if constrained else np.zeros((0, len(names)))
    first = dict(zip(start.names, start.beta.tolist(), strict=True)) if start else {}
    begin = np.array([first.get(f, 0.0) for f in names]) / scales
    curvature = _curvature(made, begin * scales, scales, own)
    found = convex.minimise(objective, begin, TOLERANCE, convex.Constraints(matrix) if len(matrix) else None, iterations, curvature)
    if not found.converged:
        raise RuntimeError(f"the fit of {families} stopped after {found.steps} steps with a gradient of {found.gradient:.2g}")
    return Model(spark, names, found.x * scales, families, found.gradient, found.steps)


#: Parameters whose second derivatives by pairs a fit scales its steps with, at most; that many squared are half a task's sums.
DENSE = 700


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix by the sweep operator, in one thread: the numerical library's own threads,
    which the driver's start of Spark interrupts, were seen to wait for ever in ``linalg.inv``."""
    a = matrix.copy()
    for k in range(len(a)):
        pivot, row = a[k, k], a[k].copy()
        a -= np.multiply.outer(row / pivot, row)
        a[k] = a[:, k] = row / pivot
        a[k, k] = -1 / pivot
    return -a


def _curvature(made: Prepared, beta: np.ndarray, scales: np.ndarray, own: np.ndarray):
    """What ``convex.minimise`` scales steps by: the diagonal of the second derivatives, and between the blocks of fewest features all of
    them, since classes, characters and characters by mode are met together and a diagonal alone takes many steps to part them."""
    diagonal = (convex.logistic_curvature(made.packed, beta) * scales * scales + own) / made.total
    diagonal = np.maximum(diagonal, 1e-9 * diagonal.max())
    of = [f.split(":", 1)[0] for f in made.names]
    sizes, chosen = Counter(of), set()
    for block in sorted(sizes, key=lambda b: (sizes[b], b)):
        if sum(sizes[b] for b in chosen) + sizes[block] <= DENSE:
            chosen.add(block)
    at = np.array([k for k, b in enumerate(of) if b in chosen], int)
    if len(at) < 2:
        return diagonal
    matrix = convex.logistic_block(made.packed, beta, at) * np.outer(scales[at], scales[at]) / made.total
    matrix[np.diag_indices(len(at))] = diagonal[at]
    inverse = _inverse(matrix)

    def solve(v: np.ndarray) -> np.ndarray:
        out = v / diagonal
        out[at] = (inverse * v[at]).sum(axis=1)
        return out

    return solve


def predict_all(models: list[Model], drafts: DataFrame) -> DataFrame:
    """``drafts`` with z0, z1, ... of the models; the entries of all their families are made once."""
    families = list(dict.fromkeys(f for m in models for f in m.families))
    names = list(dict.fromkeys(f for m in models for f in m.names))
    place = {f: k for k, f in enumerate(names)}
    betas = np.zeros((len(models), len(names)))
    for k, m in enumerate(models):
        betas[k, [place[f] for f in m.names]] = m.beta
    held = drafts.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), betas))
    schema = StructType([*drafts.schema.fields, *[StructField(f"z{k}", DoubleType()) for k in range(len(models))]])

    def run(batches):
        names, betas = held.value
        for batch in batches:
            row, number, value = _entries(batch.column("_e"), names)
            z = [np.bincount(row, value * beta[number], minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows) for beta in betas]
            kept = [n for n in batch.schema.names if n != "_e"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *map(pa.array, z)], names=[*kept, *[f"z{k}" for k in range(len(z))]])

    return drafts.withColumn("_e", design.entries(families)).mapInArrow(run, schema)


def temperature(scored: DataFrame, steps: int = 12) -> float:
    """The divisor of z that minimises log loss of y; Newton steps, each one aggregate."""
    inverse = 1.0
    for _ in range(steps):
        p = sigmoid(F.col("z") * inverse)
        g, h = scored.agg(F.sum((p - F.col("y")) * F.col("z")), F.sum(p * (1 - p) * F.col("z") * F.col("z"))).first()
        if not h:
            break
        inverse = min(10.0, max(0.1, inverse - g / h))
    return 1 / inverse


def search(train: DataFrame, check: DataFrame, families: list[str], blocks: list[str], grid: list[float], sweeps: int = 2) -> tuple[dict[str, float], list[tuple[int, str, float, float]]]:
    """Penalties of the blocks by coordinate search: each in turn takes the grid's value with the
    least log loss on ``check``, until a sweep changes none.  Also all that was tried: sweep, block, penalty, loss."""
    from trifold.operators.metrics import losses

    best, tried, known = {b: PENALTY[b] for b in blocks}, [], {}
    made, asked = prepare(train, families), durable(alike(check, families))

    def loss(penalty: dict[str, float]) -> float:
        key = tuple(sorted(penalty.items()))
        if key not in known:
            known[key] = losses(fit(made, families, penalty).predict(asked), w="w").first()["log_loss"]
        return known[key]

    for sweep_at in range(sweeps):
        before = dict(best)
        for b in blocks:
            scores = [(loss(best | {b: v}), v) for v in grid]
            tried += [(sweep_at, b, v, x) for x, v in scores]
            best[b] = min(scores)[1]
        if best == before:
            break
    return best, tried


def sweep(coefficients: DataFrame, child: str, parent: str) -> DataFrame:
    """Moves the mean of a child's cells into its parent, which changes no prediction when every cell is present.

    Features are child:cell:id and parent:id; n_cells is the number of cells seen for an id."""
    parts = F.split("feature", ":")
    cells = coefficients.where(parts[0] == child).withColumn("id", parts[2])
    mean = cells.groupBy("id").agg(F.avg("beta").alias("shift"))
    own = coefficients.where(parts[0] == parent).withColumn("id", parts[1]).join(mean, "id", "full")
    up = own.select(F.concat_ws(":", F.lit(parent), "id").alias("feature"), (F.coalesce("beta", F.lit(0.0)) + F.coalesce("shift", F.lit(0.0))).alias("beta"))
    down = cells.join(mean, "id").select("feature", (F.col("beta") - F.col("shift")).alias("beta"))
    rest = coefficients.where(~parts[0].isin(child, parent)).select("feature", "beta")
    return up.unionByName(down).unionByName(rest)


def curvature(model: Model, cells: DataFrame) -> dict[str, float]:
    """The diagonal of the log loss's second derivatives at the model: per feature, the sum of w p (1 - p) value^2 over ``alike``'s rows."""
    scored = model.predict(cells).withColumn("_v", F.col("w") * F.col("p") * (1 - F.col("p")))
    each = scored.select("_v", F.explode(design.entries(model.families)).alias("e")).groupBy("e.feature").agg(F.sum(F.col("_v") * F.col("e.value") * F.col("e.value")).alias("h"))
    return {r["feature"]: r["h"] for r in each.collect()}  # the parameters, not the rows


#: Spread of a block's coefficients that evidence may find, and the change by which it has settled.
LEAST_SPREAD, MOST_SPREAD, SETTLED = 1e-3, 2.0, 1e-3


def evidence(train: DataFrame, families: list[str], blocks: list[str], rounds: int = 30, spread: float = 0.3) -> tuple[Model, dict[str, float], bool]:
    """Empirical Bayes: penalties 1 / spread^2 of the blocks by evidence, each block's spread^2 being the sum of its squared
    coefficients over its number of well-determined ones.  The model, the penalties, and whether they settled.

    Features of a block may not meet in one match's entry, so that the diagonal of
    the curvature is that of single entries.  Each round's fit begins where the last ended."""
    spreads, model, settled = dict.fromkeys(blocks, spread), None, False
    made = prepare(train, families)
    for _ in range(rounds):
        penalty = {b: 1 / s**2 for b, s in spreads.items()}
        model = fit(made, families, penalty, start=model)
        h, change = curvature(model, made.cells), 0.0
        for b in blocks:
            own = [(beta, h.get(f, 0.0)) for f, beta in zip(model.names, model.beta.tolist(), strict=True) if f.split(":", 1)[0] == b]
            known = sum(x / (x + penalty[b]) for _, x in own)
            # A block that the prior alone decides keeps its spread.
            new = math.sqrt(sum(beta * beta for beta, _ in own) / known) if known > 1e-6 else spreads[b]
            new = min(MOST_SPREAD, max(LEAST_SPREAD, new))
            change, spreads[b] = max(change, abs(new - spreads[b]) / spreads[b]), new
        if change < SETTLED:
            settled = True
            break
    penalty = {b: 1 / s**2 for b, s in spreads.items()}
    return fit(made, families, penalty, start=model), penalty, settled
