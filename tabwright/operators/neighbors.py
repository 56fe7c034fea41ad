"""Exact k-nearest-neighbour classification without a cross join.

Rows go to the cell of their nearest pivot. Bounds on the k-th distance of every cell tell which
training rows can matter to which test cell; the triangle inequality rules out the rest. What is
left meets in blocks of bounded size, so a crowded cell becomes many tasks. Equal points are one: of the training rows at
a point the k smallest keys take part, and test rows at a point share their answer.
(Lu, Shen, Chen, Ooi: Efficient processing of k nearest neighbor joins using MapReduce, 2012.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.hashing import digest, digest_prefix
from ..plans.scalars import col
from ..session import settle

MAX_PIVOTS = 512
ROWS_PER_PIVOT = 2000
TEST_BLOCK = 4096
TRAIN_BLOCK = 16_384
SLICE = 256
SAFETY = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed feature by feature."""
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        total += (a[:, f][:, None] - b[:, f][None, :]) ** 2
    return np.sqrt(total)


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    @F.pandas_udf("cell int, reach double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            d = _distances(np.stack(x.to_numpy()), pivots)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype("int32"), "reach": d[np.arange(len(cell)), cell]})

    return df.withColumn("_n", nearest("x")).select("*", "_n.cell", "_n.reach").drop("_n")


def _block_neighbours(k: int):
    def find(key: tuple, test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if test.empty or train.empty:
            return pd.DataFrame({"_test": [], "d": [], "_train": [], "label": []})
        # Ties in distance go to the smaller training key.
        train = train.sort_values("_train", kind="stable").reset_index(drop=True)
        b = np.stack(train["x"].to_numpy())
        ids, labels = train["_train"].to_numpy(), train["label"].to_numpy()
        take = min(k, len(train))
        parts = []
        for start in range(0, len(test), SLICE):
            piece = test.iloc[start : start + SLICE]
            d = _distances(np.stack(piece["x"].to_numpy()), b)
            best = np.argpartition(d, take - 1, axis=1)[:, :take]
            last = np.take_along_axis(d, best, axis=1).max(axis=1)
            for i in np.flatnonzero((d <= last[:, None]).sum(axis=1) > take):
                best[i] = np.argsort(d[i], kind="stable")[:take]
            parts.append(
                pd.DataFrame(
                    {
                        "_test": np.repeat(piece["_test"].to_numpy(), take),
                        "d": np.take_along_axis(d, best, axis=1).ravel(),
                        "_train": ids[best].ravel(),
                        "label": labels[best].ravel(),
                    }
                )
            )
        return pd.concat(parts)

    return find


def points_of(test: DataFrame, features: list[str], key: str) -> DataFrame:
    """(_test, x): every distinct point of the test rows, under the smallest key at it."""
    return test.select(col(key).alias("_test"), vector_of(features).alias("x")).groupBy("x").agg(F.min("_test").alias("_test")).select("_test", "x")


def for_every_row(test: DataFrame, features: list[str], key: str, points: DataFrame, found: DataFrame) -> DataFrame:
    """(key, neighbours): each test row with the neighbours (``_test``, ``neighbours``) of its point."""
    answers = points.join(found, "_test").select("x", "neighbours")
    return test.select(col(key), vector_of(features).alias("x")).distinct().join(answers, "x").drop("x")


def offers_of(train: DataFrame, features: list[str], label: str, key: str, k: int) -> DataFrame:
    """(_train, label, x): of equal training points the k smallest keys; no other can be a neighbour.

    Spark keeps the first k rows of every point in each task before it shuffles.
    """
    place = F.row_number().over(W.partitionBy("x").orderBy("_train"))
    rows = train.select(col(key).alias("_train"), col(label).cast("double").alias("label"), vector_of(features).alias("x"))
    return rows.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def vector_of(features: list[str]) -> Column:
    return F.array(*[col(f).cast("double") for f in features])


def nearest_neighbours(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5
) -> DataFrame:
    """(key, neighbours): for each test row the k nearest training rows as (d, _train, label).

    ``key`` is unique in both tables. Distance ties go to the smaller key. Equal test points are searched for once.
    """
    points = settle(points_of(test, features, key))
    left, right = points, settle(offers_of(train, features, label, key, k))
    n_train = right.count()
    if not n_train:
        raise ValueError("no training rows")
    n_pivots = min(MAX_PIVOTS, max(1, math.ceil(n_train / ROWS_PER_PIVOT)))
    chosen = right.orderBy(digest(F.col("_train")), "_train").limit(n_pivots).select("x").collect()
    pivots = np.array([r.x for r in chosen])

    left, right = _with_cell(left, pivots), _with_cell(right, pivots)
    # Facts per cell, at most 512 cells: test extent, and the k smallest training distances.
    extent = {r.cell: (r.far, r.n) for r in left.groupBy("cell").agg(F.max("reach").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    # Spark keeps the first k rows of every cell in each task before it shuffles, so a crowded cell meets nowhere.
    place = F.row_number().over(W.partitionBy("cell").orderBy("reach"))
    closest = right.select("cell", "reach", place.alias("p")).where(F.col("p") <= k).collect()
    between = _distances(pivots, pivots)
    bound = {}
    for i, (far, _) in extent.items():
        uppers = sorted(far + between[i, r.cell] + r.reach for r in closest)
        bound[i] = uppers[k - 1] if len(uppers) >= k else math.inf
    cells = np.array(sorted(extent), dtype="int64")
    far = np.array([extent[i][0] for i in cells])
    limit = np.array([bound[i] for i in cells]) * (1 + SAFETY) + SAFETY

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(cell: pd.Series, reach: pd.Series) -> pd.Series:
        gap = between[cell.to_numpy()][:, cells]
        r = reach.to_numpy()[:, None]
        useful = (gap - far - r <= limit) & (r - gap - far <= limit)
        return pd.Series([cells[row].astype("int32") for row in useful])

    spread = right.select("_train", "label", "x", F.explode(targets("cell", "reach")).alias("cell"))
    load = {r.cell: r.n for r in spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Blocks per cell; a literal map with one entry per cell.
    test_blocks = {i: math.ceil(n / TEST_BLOCK) for i, (_, n) in extent.items()}
    train_blocks = {i: max(1, math.ceil(load.get(i, 0) / TRAIN_BLOCK)) for i in extent}

    def blocks(of: dict) -> Column:
        table = F.create_map(*[F.lit(v) for pair in of.items() for v in (int(pair[0]), int(pair[1]))])
        return F.element_at(table, F.col("cell"))

    def every(of: dict) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(of) - 1))

    def own(key_col: str, of: dict) -> Column:
        return F.pmod(digest_prefix(digest(F.col(key_col)), 8), blocks(of)).cast("int")

    probes = left.select("_test", "x", "cell", own("_test", test_blocks).alias("a"), every(train_blocks).alias("b"))
    offers = spread.select(
        "_train", "label", "x", "cell", every(test_blocks).alias("a"), own("_train", train_blocks).alias("b")
    )
    kinds = {"t": left.schema["_test"].dataType.simpleString(), "s": right.schema["_train"].dataType.simpleString()}
    found = (
        probes.groupBy("cell", "a", "b")
        .cogroup(offers.groupBy("cell", "a", "b"))
        .applyInPandas(_block_neighbours(k), f"_test {kinds['t']}, d double, _train {kinds['s']}, label double")
    )
    # At most k rows per block reach a test row.
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "_train", "label"))), 1, k)
    return for_every_row(test, features, key, points, found.groupBy("_test").agg(near.alias("neighbours")))


def vote(test: DataFrame, near: DataFrame, key: str, prediction: str) -> DataFrame:
    """``test`` with the majority label of its neighbours, the smallest of several."""
    labels = F.transform("neighbours", lambda n: n["label"])
    votes = F.transform(
        F.array_distinct(labels),
        lambda v: F.struct(F.size(F.filter(labels, lambda x: x == v)).alias("n"), (-v).alias("minus")),
    )
    return test.join(near.select(col(key), (-F.array_max(votes)["minus"]).alias(prediction)), key)


def knn_classifier(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5, prediction: str = "prediction"
) -> DataFrame:
    """``test`` with the majority label of the k nearest training rows, the smallest of several."""
    return vote(test, nearest_neighbours(train, test, features, label, key, k), key, prediction)
