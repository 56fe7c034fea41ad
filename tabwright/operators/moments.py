"""Means and cross products of groups of rows in one scan, and all linear models that follow from them.

Every task reduces its rows to one matrix for each group; matrices are merged by the rule for means and centred products of two
sets, which loses no digits to large means. The moments of a training set are those of its folds merged, so any number of
folds, penalties and mixes costs one pass over the rows and no second one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..plans.scalars import col

#: Matrices of one group that are merged in one place.
FAN_IN = 64
SCHEMA = "part long, n long, mean array<double>, cross array<double>"


@dataclass
class Moments:
    """Rows, means and centred products of inputs and label (last)."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.cross + other.cross + np.outer(apart, apart) * (self.n / n * other.n))

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred)

    # ---- models ----

    def ridge(self, alpha: float) -> np.ndarray:
        """Weights and offset that minimise |y - Xw - b|² + alpha·|w|²; the shortest ones if there are several."""
        d = len(self.mean) - 1
        w = np.linalg.lstsq(self.cross[:d, :d] + alpha * np.eye(d), self.cross[:d, d], rcond=1e-13)[0]
        return np.append(w, self.mean[d] - w @ self.mean[:d])

    def elastic_net(self, alpha: float, l1_ratio: float, tol: float = 1e-12, rounds: int = 100_000) -> np.ndarray:
        """Weights and offset that minimise |y - Xw - b|²/2n + alpha(r·|w|₁ + (1 - r)·|w|²/2), one weight at a time."""
        d = len(self.mean) - 1
        gram, target = self.cross[:d, :d] / self.n, self.cross[:d, d] / self.n
        w, edge = np.zeros(d), alpha * l1_ratio
        for _ in range(rounds):
            largest = 0.0
            for j in range(d):
                rest = target[j] - gram[j] @ w + gram[j, j] * w[j]
                below = gram[j, j] + alpha * (1 - l1_ratio)
                new = np.sign(rest) * max(abs(rest) - edge, 0.0) / below if below > 0 else 0.0
                largest = max(largest, abs(new - w[j]) * np.sqrt(gram[j, j]))
                w[j] = new
            if largest <= tol * max(np.sqrt(self.cross[d, d] / self.n), 1e-300):
                break
        return np.append(w, self.mean[d] - w @ self.mean[:d])

    def squared_error(self, weights: np.ndarray) -> float:
        """Sum of squared errors of a linear model on these rows."""
        d = len(self.mean) - 1
        w, b = weights[:d], weights[d]
        bias = self.mean[d] - b - w @ self.mean[:d]
        return float(self.cross[d, d] - 2 * w @ self.cross[:d, d] + w @ self.cross[:d, :d] @ w + self.n * bias**2)

    def r2(self, weights: np.ndarray) -> float | None:
        d = len(self.mean) - 1
        return 1 - self.squared_error(weights) / float(self.cross[d, d]) if self.n and self.cross[d, d] > 0 else None


def _row(part: int, m: Moments) -> dict:
    return {"part": part, "n": m.n, "mean": m.mean.tolist(), "cross": m.cross.ravel().tolist()}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("cross", pa.list_(pa.float64()))]))


def _read(n, mean, cross) -> Moments:
    mean = np.asarray(mean, float)
    return Moments(int(n), mean, np.asarray(cross, float).reshape(len(mean), len(mean)))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of each group among a task's rows (``part``, ``z``)."""
    found: dict[int, Moments] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        for p in np.unique(part).tolist():
            own = Moments.of(z[part == p])
            found[p] = found[p].merge(own) if p in found else own
    yield from _table([_row(p, m) for p, m in found.items()]).to_batches()


def _merge(rows: pa.Table) -> pa.Table:
    parts = sorted(rows.to_pylist(), key=lambda r: (r["n"], r["mean"]))
    merged = reduce(Moments.merge, (_read(r["n"], r["mean"], r["cross"]) for r in parts))
    return _table([_row(parts[0]["part"], merged)])


def moments_by(df: DataFrame, features_col: str, label_col: str, group: str) -> dict[int, Moments]:
    """The moments of each value of the whole-number column ``group``, in one scan. Rows without a label take no part."""
    y = col(label_col).cast("double")
    z = F.concat(vector_to_array(col(features_col)), F.array(y))
    rows = df.where(y.isNotNull()).select(col(group).cast("long").alias("part"), z.alias("z"))
    local = rows.mapInArrow(_reduce, SCHEMA).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    few = local.groupBy("part", "slot").applyInArrow(lambda t: _merge(t.drop_columns(["slot"])), SCHEMA)
    # One matrix for each group.
    return {r.part: _read(r.n, r.mean, r.cross) for r in few.groupBy("part").applyInArrow(_merge, SCHEMA).collect()}
