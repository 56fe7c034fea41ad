"""k-means clustering: all starts advance together, one pass over the rows for each iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import as_double
from ..plans.scalars import col, scalar_row
from .coltypes import is_numeric, is_string

MIN_CLUSTERS, MAX_CLUSTERS = 2, 10
#: Rows from which the starts draw their first centres, those of smallest hash. Every later step sees all rows.
SEEDING = 10_000
#: Rows whose distances are held at once.
STEP = 4096


class Centres:
    """Cluster centres; a row belongs to the nearest one, the first of equally near ones."""

    def __init__(self, points: np.ndarray, features_col: str = "features", prediction_col: str = "cluster"):
        self.points, self.features_col, self.prediction_col = points, features_col, prediction_col

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 (as on Spark's own models)
        return list(self.points)

    def transform(self, df: DataFrame) -> DataFrame:
        points = self.points

        @F.pandas_udf("int")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in batches:
                x = np.stack(series.to_numpy()) if len(series) else np.empty((0, points.shape[1]))
                parts = [_nearest(x[k : k + STEP], points) for k in range(0, len(x), STEP)]
                yield pd.Series(np.concatenate(parts) if parts else np.empty(0), dtype="int32")

        return df.withColumn(self.prediction_col, nearest(vector_to_array(col(self.features_col))))


@dataclass
class Clustering:
    """The best of several k-means runs, the labelled rows, the cost of every start and the iterations it took."""

    model: Centres
    labelled: DataFrame
    k: int
    inertia: float
    costs: list[float]
    iterations: list[int]


def _names(df: DataFrame, cols: list[str] | None) -> list[str]:
    return cols or [f.name for f in df.schema if is_numeric(f.dataType) or is_string(f.dataType)]


def scaled_inputs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``df`` with a ``features`` vector: coerced, mean-filled, centred, population-scaled columns."""
    names = _names(df, cols)
    if len(names) < 2:
        raise ValueError("clustering needs two numeric columns")
    coerced = df.select("*", *[as_double(col(c), df.schema[c].dataType).alias(f"_in{i}") for i, c in enumerate(names)])
    inputs = [f"_in{i}" for i in range(len(names))]
    facts = scalar_row(
        coerced,
        **{f"m{i}": F.avg(c) for i, c in enumerate(inputs)},
        **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(inputs)},
    )
    # A mean-filled cell scales to 0. A fill adds no deviation but counts in n.
    share = scalar_row(coerced, **{f"r{i}": F.sqrt(F.count(c) / F.count(F.lit(1))) for i, c in enumerate(inputs)})
    scaled = coerced.select(
        *[col(c) for c in df.columns],
        *[
            F.coalesce(F.try_divide(F.col(c) - facts[f"m{i}"], facts[f"s{i}"] * share[f"r{i}"]), F.lit(0.0)).alias(c)
            for i, c in enumerate(inputs)
        ],
    )
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(scaled).drop(*inputs)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points, by differences: exact enough to compare near ones."""
    return ((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)


#: Of the lengths involved, how much two squared distances by products must differ to be told apart.
NEAR_TIE = 1e-9


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The first of the nearest points to each row: by matrix products, and by differences where two are all but equally near."""
    lengths = (points**2).sum(axis=1)
    far = lengths - 2.0 * (x @ points.T)
    mine = far.argmin(axis=1)
    least = far[np.arange(len(x)), mine]
    slack = NEAR_TIE * ((x**2).sum(axis=1) + lengths.max())
    close = np.flatnonzero(~((far <= (least + slack)[:, None]).sum(axis=1) == 1))
    if len(close):
        mine[close] = _distances(x[close], points).argmin(axis=1)
    return mine


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn by its squared distance to the nearest one so far."""
    rng = np.random.default_rng(seed)
    points = sample[rng.integers(len(sample))][None, :]
    while len(points) < k:
        far = _distances(sample, points).min(axis=1)
        total = far.sum()
        at = int(np.searchsorted(np.cumsum(far), rng.random() * total, "right")) if total else int(rng.integers(len(sample)))
        points = np.vstack([points, sample[min(at, len(sample) - 1)]])
    return points


def _pass(rows: DataFrame, starts: list[np.ndarray], costs: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each start: rows of each cluster, sums of their inputs, and (0 unless asked for) the cost. One scan; a task gives one row of
    numbers."""
    k, d = starts[0].shape
    shared = rows.sparkSession.sparkContext.broadcast(starts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), k * (d + 1) + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(x), STEP):
                part = x[at : at + STEP]
                for s, points in enumerate(shared.value):
                    mine = _nearest(part, points)
                    member = np.zeros((len(part), k))
                    member[np.arange(len(part)), mine] = 1.0
                    total[s, :k] += member.sum(axis=0)
                    total[s, k:-1] += (member.T @ part).ravel()
                    if costs:
                        total[s, -1] += ((part - points[mine]) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["total"])

    numbers = rows.mapInArrow(assign, "total array<double>").select(F.posexplode("total"))
    # As many rows as all starts have numbers.
    sums = np.array([r.s for r in numbers.groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()]).reshape(len(starts), -1)
    shared.unpersist()
    return [(t[:k], t[k:-1].reshape(k, d), float(t[-1])) for t in sums]


def kmeans(
    df: DataFrame, cols: list[str] | None = None, k: int = 3, seed: int = 42, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4
) -> Clustering:
    """Standardised k-means, the start with the lowest cost out of ``n_init``; adds ``cluster``.

    A start ends when its centres move by no more than ``tol`` in all (squared, of inputs with variance one) and leaves the passes. A
    cluster that loses all rows keeps its centre. The first centres depend on the rows and ``seed`` alone.
    """
    if not MIN_CLUSTERS <= k <= MAX_CLUSTERS:
        raise ValueError(f"k must lie in {MIN_CLUSTERS}..{MAX_CLUSTERS}")
    scaled = scaled_inputs(df, cols)
    rows = scaled.select(vector_to_array("features").alias("x")).persist()
    try:
        # Raw values have equal hashes however the rows lie; scaled ones differ in their last digits.
        raw = [col(c) for c in _names(df, cols)]
        sample = np.array([r.x for r in scaled.orderBy(F.xxhash64(*raw), *raw).select(vector_to_array("features").alias("x")).limit(SEEDING).collect()])
        if not len(sample):
            raise ValueError("clustering needs rows")
        starts = [_first_centres(sample, k, seed + i) for i in range(n_init)]
        going, iterations = list(range(n_init)), [0] * n_init
        for _ in range(max_iter):
            if not going:
                break
            for i, (counts, sums, _) in zip(list(going), _pass(rows, [starts[i] for i in going]), strict=True):
                moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], starts[i])
                iterations[i] += 1
                if ((moved - starts[i]) ** 2).sum() <= tol:
                    going.remove(i)
                starts[i] = moved
        costs = [cost for _, _, cost in _pass(rows, starts, costs=True)]
    finally:
        rows.unpersist()
    best = int(np.argmin(costs))
    model = Centres(starts[best])
    return Clustering(model, model.transform(scaled).drop("features"), k, costs[best], costs, iterations)


def kmeans_summary(result: Clustering) -> DataFrame:
    """One row: clusters, inertia, samples."""
    return result.labelled.agg(
        F.lit(result.k).cast("bigint").alias("clusters"),
        F.lit(result.inertia).alias("inertia"),
        F.count(F.lit(1)).alias("samples"),
    )
