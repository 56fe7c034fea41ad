"""Neural network and kernel regression trained on the whole gradient, summed over the cluster.

Spark has no regressor of either kind. Every step takes the exact loss and gradient of all rows and moves the weights by limited-memory
BFGS. Equal rows are counted first, so that a hot row is one row, and dealt by their hash into blocks; a block is one matrix product
over its distinct inputs, and sums follow the order of the blocks, so the fitted weights depend neither on the partitioning nor on the order of the rows.
RBF kernels become Nyström features: the kernel to landmark rows, whitened, as many as a measured kernel error asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..plans.scalars import col

#: Cells (rows times inputs) of a block; blocks that a task adds up at least, and the most such sums, which a tree adds up.
CELLS, BLOCKS, UNITS = 1 << 16, 8, 4096
#: Labels of one input beyond which they are dealt among several blocks.
HOT = 4096
#: Sums that are added in one place.
FAN_IN = 64
#: Pairs of steps and gradient changes that the optimiser remembers.
MEMORY = 10
#: Widths of the rounded corner of the epsilon-insensitive loss, in standard deviations of the label, one after the other.
CORNERS = (0.1, 0.01)


def _shapes(inputs: int, hidden: list[int]) -> list[tuple[int, int]]:
    widths = [inputs, *hidden, 1]
    return list(zip(widths, widths[1:]))


def _unpack(flat: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, cols in shapes:
        layers.append((flat[at : at + rows * cols].reshape(rows, cols), flat[at + rows * cols : at + (rows + 1) * cols]))
        at += (rows + 1) * cols
    return layers


def _forward(x: np.ndarray, layers: list) -> list[np.ndarray]:
    steps = [x]
    for i, (w, b) in enumerate(layers):
        z = steps[-1] @ w + b
        steps.append(np.maximum(z, 0) if i < len(layers) - 1 else z)
    return steps


def _points(x: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    return np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])


def _loss_sum(x, first, y, times, flat, shapes, epsilon, corner) -> tuple[float, np.ndarray]:
    """Summed loss and its gradient, without the penalty: squared error / 2, or the epsilon-insensitive error with a corner that is
    rounded over ``corner``. The labels of the inputs ``x[i]`` begin at ``first[i]``."""
    layers = _unpack(flat, shapes)
    steps = _forward(x, layers)
    error = np.repeat(steps[-1][:, 0], np.diff(np.r_[first, len(y)])) - y
    if epsilon is None:
        loss, slope = error**2 / 2, error
    else:
        over = np.maximum(np.abs(error) - epsilon, 0)
        loss = np.where(over < corner, over**2 / (2 * corner), over - corner / 2)
        slope = np.sign(error) * np.minimum(over / corner, 1)
    delta = np.add.reduceat(slope * times, first)[:, None]
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        parts.append(np.concatenate([(steps[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ w.T) * (steps[i] > 0)
    return float(loss @ times), np.concatenate(parts[::-1])


# ---- kernel features ----------------------------------------------------------------------------------------------------------


@dataclass
class Landmarks:
    """Features whose products imitate ``exp(-gamma·|a-b|²)``; ``error`` is the largest difference on the rows it was measured on."""

    points: np.ndarray
    whiten: np.ndarray
    gamma: float
    error: float

    @property
    def width(self) -> int:
        return self.whiten.shape[1]

    def features(self, x: np.ndarray) -> np.ndarray:
        return _kernel(x, self.points, self.gamma) @ self.whiten


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0))


def find_landmarks(df: DataFrame, features_col: str, gamma: float, error: float = 0.01, most: int = 1024, probes: int = 512) -> Landmarks:
    """Landmarks by doubling, until the kernel between ``probes`` other rows differs by no more than ``error``, or ``most`` are taken.

    Landmarks and probes are the distinct rows of smallest hash, which depend on the rows alone: a bounded sample that makes the features.
    The model is fitted on all rows.
    """
    x = vector_to_array(col(features_col)).alias("x")
    drawn = df.select(x).distinct().orderBy(F.xxhash64("x"), "x").limit(most + probes).collect()
    rows = np.array([r.x for r in drawn])
    tested = rows[-probes:] if len(rows) > probes else rows
    exact = _kernel(tested, tested, gamma)
    count = min(32, len(rows))
    while True:
        points = rows[:count]
        values, vectors = np.linalg.eigh(_kernel(points, points, gamma))
        kept = values > values[-1] * 1e-10
        found = Landmarks(points, vectors[:, kept] / np.sqrt(values[kept]), gamma, 0.0)
        z = found.features(tested)
        found.error = float(np.abs(z @ z.T - exact).max())
        if found.error <= error or count >= min(most, len(rows)):
            return found
        count = min(2 * count, most, len(rows))


# ---- the gradient of all rows -----------------------------------------------------------------------------------------------


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of each block, joined across batches: block, inputs, label, times."""
    held: list = []

    def joined():
        return (held[0][0], *(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)))

    for batch in batches:
        block, x, y, times = (batch.column(k) for k in range(4))
        block, y, times = block.to_numpy(), y.to_numpy(), times.to_numpy().astype(float)
        x = x.flatten().to_numpy().reshape(len(y), -1) if len(y) else np.empty((0, 0))
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[0][0] != block[a]:
                yield joined()
                held.clear()
            held.append((int(block[a]), x[a:b], y[a:b], times[a:b]))
    if held:
        yield joined()


def _unit_sums(per_unit: int, flat, shapes, epsilon, corner, kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loss and gradient of each unit of blocks, added in the order of the blocks."""
    def out(unit, total):
        return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["unit", "total"])

    unit, total = None, None
    for block, x, y, times in _whole_blocks(batches):
        first = _points(x)
        x = x[first]
        loss, gradient = _loss_sum(x if kernel is None else _kernel(x, kernel.points, kernel.gamma), first, y, times, flat.value, shapes, epsilon, corner)
        part = np.append(gradient, loss)
        if unit is not None and block // per_unit != unit:
            yield out(unit, total)
            unit = None
        unit, total = (block // per_unit, part) if unit is None else (unit, total + part)
    if unit is not None:
        yield out(unit, total)


def _add(table: pa.Table) -> pa.Table:
    order = np.argsort(table["unit"].to_numpy())
    rows = table["total"].combine_chunks()
    total = rows[int(order[0])].values.to_numpy().copy()
    for k in order[1:].tolist():
        total += rows[k].values.to_numpy()
    return pa.table({"unit": pa.array([int(table["unit"][int(order[0])].as_py()) // FAN_IN], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


class Objective:
    """Mean loss with penalty, and its gradient, of all rows of a table (``x``, ``y``)."""

    def __init__(self, rows: DataFrame, inputs: int, shapes, l2: float, epsilon: float | None, kernel: Landmarks | None):
        self.shapes, self.l2, self.epsilon, self.kernel, self.corner = shapes, l2, epsilon, kernel, CORNERS[-1]
        if epsilon is None:
            # The squared error of equal inputs is that of their mean label, and a part that no weight changes.
            same = [F.avg("y").alias("y"), F.count(F.lit(1)).alias("times"), (F.var_pop("y") * F.count(F.lit(1))).alias("within")]
            counted = rows.groupBy("x").agg(*same).persist()
        else:
            counted = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("times"), F.lit(0.0).alias("within")).persist()
        distinct, self.n, self.within = counted.agg(F.count(F.lit(1)), F.sum("times"), F.sum("within")).first()
        labels = counted.groupBy("x").agg(F.count(F.lit(1)).alias("labels"))
        points, hot = distinct, None
        if epsilon is not None:
            points = labels.agg(F.sum(F.ceil(F.col("labels") / HOT))).first()[0]
            # No more of them than one in ``HOT`` rows.
            hot = F.broadcast(labels.where(F.col("labels") > HOT))
        width = inputs if kernel is None else max(inputs, len(kernel.points))
        blocks = max(1, math.ceil((points * width + distinct) / CELLS))
        self.units = min(math.ceil(blocks / BLOCKS), UNITS)
        self.per_unit = math.ceil(blocks / self.units)
        # The labels of one input share its forward pass in one block, or in several where they are many.
        spread = F.lit(0) if hot is None else F.coalesce(F.pmod(F.xxhash64("y"), F.ceil(F.col("labels") / HOT)), F.lit(0)).cast("int")
        block = F.pmod(F.xxhash64("x", spread), F.lit(self.units * self.per_unit))
        placed = counted if hot is None else counted.join(hot, "x", "left")
        dealt = placed.select(block.alias("block"), "x", "y", "times").repartition(self.units, F.floor(F.col("block") / self.per_unit))
        self.rows = dealt.sortWithinPartitions("block", "x", "y").persist()
        self.rows.count()
        counted.unpersist()
        # The penalty is on weights, not on offsets.
        self.free = np.concatenate([np.repeat([1.0, 0.0], [a * b, b]) for a, b in shapes])

    def __call__(self, flat: np.ndarray) -> tuple[float, np.ndarray]:
        shared = self.rows.sparkSession.sparkContext.broadcast(self._outward(flat))
        step = partial(_unit_sums, self.per_unit, shared, self._shapes_outside(), self.epsilon, self.corner, self.kernel)
        schema = "unit long, total array<double>"
        sums, left = self.rows.mapInArrow(step, schema), self.units
        while left > FAN_IN:
            sums, left = sums.groupBy(F.floor(F.col("unit") / FAN_IN).alias("above")).applyInArrow(_add, schema), math.ceil(left / FAN_IN)
        # At most FAN_IN rows of the model's size.
        total = sum(np.array(r.total) for r in sorted(sums.collect(), key=lambda r: r.unit))
        shared.unpersist()
        weights = flat * self.free
        loss = (total[-1] + self.within / 2) / self.n + self.l2 * float(weights @ weights) / 2
        return loss, self._inward(total[:-1]) / self.n + self.l2 * weights

    # Tasks work on the kernel to the landmarks themselves; whitening is left to the first layer, here.

    def _shapes_outside(self) -> list[tuple[int, int]]:
        return self.shapes if self.kernel is None else [(len(self.kernel.points), self.shapes[0][1]), *self.shapes[1:]]

    def _outward(self, flat: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return flat
        a, b = self.shapes[0]
        return np.concatenate([(self.kernel.whiten @ flat[: a * b].reshape(a, b)).ravel(), flat[a * b :]])

    def _inward(self, gradient: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return gradient
        a, b = len(self.kernel.points), self.shapes[0][1]
        return np.concatenate([(self.kernel.whiten.T @ gradient[: a * b].reshape(a, b)).ravel(), gradient[a * b :]])

    def close(self) -> None:
        self.rows.unpersist()


@dataclass
class Descent:
    """How a fit went: loss and largest slope after each step, and whether it ended by itself."""

    steps: list[tuple[int, float, float]] = field(default_factory=list)
    converged: bool = False


def descend(objective: Callable, start: np.ndarray, max_iter: int | None, tol: float, patience: int, report: Descent) -> np.ndarray:
    """Limited-memory BFGS with backtracking. Ends when ``patience`` steps together gain less than ``tol``, no step down is found, or
    after ``max_iter`` steps in all."""
    at = start
    loss, slope = objective(at)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    losses = [loss]
    report.converged = False
    while max_iter is None or len(report.steps) < max_iter:
        q, scales = slope.copy(), []
        for s, y in reversed(pairs):
            scales.append(float(s @ q) / float(s @ y))
            q -= scales[-1] * y
        q *= float(pairs[-1][0] @ pairs[-1][1]) / float(pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(pairs, reversed(scales), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        fall = float(slope @ q)
        if fall <= 0:
            pairs, q, fall = [], slope, float(slope @ slope)
        size, found = 1.0, None
        while size > 1e-10:
            there = at - size * q
            new, new_slope = objective(there)
            if new <= loss - 1e-4 * size * fall:
                found = there
                break
            size /= 2 if size > 1e-3 else 10
        if found is None:
            report.converged = True
            break
        change = (found - at, new_slope - slope)
        if float(change[0] @ change[1]) > 1e-12 * float(change[1] @ change[1]):
            pairs = [*pairs, change][-MEMORY:]
        at, loss, slope = found, new, new_slope
        losses.append(loss)
        report.steps.append((len(report.steps) + 1, float(loss), float(np.abs(slope).max())))
        if len(losses) > patience and losses[-1 - patience] - loss < tol:
            report.converged = True
            break
    return at


# ---- the models -----------------------------------------------------------------------------------------------------------------


@dataclass
class NetworkModel:
    """Weights of a fitted network; ``transform`` adds a prediction column."""

    weights: np.ndarray
    shapes: list
    mean: float
    scale: float
    features_col: str
    prediction_col: str
    report: Descent
    kernel: Landmarks | None = None

    @property
    def rounds(self) -> int:
        return len(self.report.steps)

    def convergence(self, df: DataFrame) -> DataFrame:
        """``step``, ``loss``, ``slope`` of the fit, in the session of ``df``."""
        return df.sparkSession.createDataFrame(self.report.steps, "step int, loss double, slope double")

    def transform(self, df: DataFrame) -> DataFrame:
        weights, shapes, mean, scale, kernel = self.weights, self.shapes, self.mean, self.scale, self.kernel

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            layers = _unpack(weights, shapes)
            for series in batches:
                x = np.stack(series.to_numpy())
                x = x if kernel is None else kernel.features(x)
                yield pd.Series(_forward(x, layers)[-1][:, 0] * scale + mean)

        return df.withColumn(self.prediction_col, predict(vector_to_array(col(self.features_col))))


def fit_network(
    df: DataFrame, features_col: str, label_col: str, hidden: list[int], max_iter: int | None = 500, l2: float = 1e-4,
    epsilon: float | None = None, cost: float | None = None, kernel: Landmarks | None = None, seed: int = 42, tol: float = 1e-4,
    patience: int = 10, prediction_col: str = "prediction",
) -> NetworkModel:
    """Train on scaled features; the label is standardised inside.

    ``epsilon`` (in label units) selects the epsilon-insensitive loss with penalty 1/(cost·n). Its corners are rounded,
    less and less, so that the last loss differs from the exact one by no more than half of the last of ``CORNERS``.
    """
    y = col(label_col).cast("double")
    n, mean, scale = df.agg(F.count(y), F.avg(y), F.stddev_pop(y)).first()
    scale = scale or 1.0
    rows = df.select(vector_to_array(col(features_col)).alias("x"), ((y - mean) / scale).alias("y")).where("y is not null")
    inputs = len(rows.select("x").first().x)
    shapes = _shapes(inputs if kernel is None else kernel.width, hidden)
    if epsilon is not None:
        epsilon, l2 = epsilon / scale, scale / (cost * n)
    rng = np.random.default_rng(seed)
    start = []
    for a, b in shapes:
        edge = math.sqrt(6 / (a + b))
        # A model without hidden layers has one optimum and starts from nothing.
        start += [rng.uniform(-edge, edge, a * b) if hidden else np.zeros(a * b), np.zeros(b)]
    weights, report = np.concatenate(start), Descent()
    objective = Objective(rows, inputs, shapes, l2, epsilon, kernel)
    try:
        for corner in CORNERS if epsilon is not None else CORNERS[-1:]:
            objective.corner = corner
            weights = descend(objective, weights, max_iter, tol, patience, report)
    finally:
        objective.close()
    return NetworkModel(weights, shapes, mean, scale, features_col, prediction_col, report, kernel)
