"""Approximate k-nearest neighbours by bucketed random projections, with measured recall.

Every table cuts a few random directions into cells of one width; rows of one cell meet. Beside its own cell a test row visits
the neighbouring cells whose borders lie closest, so few tables suffice. Nothing is set by hand: cell width follows from
exact neighbour distances of a bounded sample of test rows, the number of directions from how many training rows share a cell, and
tables are doubled until the exact neighbours of the sample are met with the wanted recall. Test rows that meet fewer than k training
rows are answered by the exact join. (Lv, Josephson, Wang, Charikar, Li: Multi-probe LSH, 2007.)

Of equal training points the k smallest keys can be neighbours; the others leave before any table is built, so a point that a third of
all rows share costs k rows; test rows at one point share a search and its answer. Crowded cells are split into blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import digest, digest_prefix
from ..plans.scalars import col
from ..session import settle
from . import neighbors
from .neighbors import for_every_row, nearest_neighbours, offers_of, points_of, vector_of, vote

#: Test rows whose exact neighbours are computed, and training rows on which the cells are counted.
SAMPLE, TRAIN_SAMPLE = 256, 4096
#: Training rows that one visit to a cell should meet on average.
CANDIDATES = 2000
MAX_DIRECTIONS = 12
#: Width of a cell in distances to the k-th neighbour.
WIDTHS = 4.0
PROBES = 16
FIRST_TABLES, MAX_TABLES = 4, 64
ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Projections:
    """Cells of ``tables`` x ``functions`` random directions, and the recall they were chosen for."""

    directions: np.ndarray
    offsets: np.ndarray
    factors: np.ndarray
    salts: np.ndarray
    width: float
    probes: int
    recall: float = 0.0
    trials: list[tuple[int, float]] = field(default_factory=list)

    @staticmethod
    def drawn(inputs: int, functions: int, tables: int, width: float, probes: int, seed: int) -> Projections:
        """The first tables are the same however many are drawn."""
        draws = [np.random.default_rng((seed, t)) for t in range(tables)]
        odd = np.random.default_rng((seed, -1 % 2**32)).integers(-(2**62), 2**62, functions) * 2 + 1
        return Projections(
            np.stack([d.normal(size=(functions, inputs)) for d in draws]), np.stack([d.random(functions) for d in draws]),
            odd, np.array([d.integers(-(2**62), 2**62) for d in draws]), width, probes,
        )

    def _places(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ri,tfi->rtf", x, self.directions) / self.width + self.offsets

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        # Whole numbers wrap around; two cells with one key only add candidates.
        return (cells.astype("int64") * self.factors).sum(axis=2) + self.salts

    def own(self, x: np.ndarray) -> np.ndarray:
        """The key of each row's cell in every table."""
        return self._keys(np.floor(self._places(x)))

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The keys of the cells that a test row visits: its own and the closest ones beside it."""
        places = self._places(x)
        cells = np.floor(places)
        inside, keys = places - cells, self._keys(cells)
        functions = cells.shape[2]
        # One step down or up in one direction, or in two; the cost is the squared distance to the borders crossed.
        one = np.concatenate([inside**2, (1 - inside) ** 2], axis=2)
        steps = np.concatenate([-self.factors, self.factors])
        pairs = [(i, j) for i, j in combinations(range(2 * functions), 2) if j - i != functions]
        i, j = (np.array(p, dtype="int64") for p in zip(*pairs)) if pairs else (np.zeros(0, "int64"),) * 2
        cost = np.concatenate([one, one[:, :, i] + one[:, :, j]], axis=2)
        moves = np.concatenate([steps, steps[i] + steps[j]])
        take = min(self.probes, cost.shape[2])
        best = np.argpartition(cost, take - 1, axis=2)[:, :, :take]
        return np.concatenate([keys[:, :, None], keys[:, :, None] + moves[best]], axis=2).reshape(len(x), -1)


def _first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(digest(col(key)), col(key)).limit(n)


def fit_projections(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5, recall: float = 0.95, seed: int = 42
) -> Projections:
    """Tables that meet the exact neighbours of ``SAMPLE`` test rows with the wanted recall, two standard errors above it.

    ``trials`` lists the tables tried and their recall; with ``MAX_TABLES`` the last recall may be lower than wanted.
    """
    asked = settle(_first_rows(test, key, SAMPLE))
    exact = nearest_neighbours(train, asked, features, label, key, k)
    at, it = vector_of(features), F.explode("neighbours").alias("n")
    pairs = settle(exact.select(col(key).alias("_test"), it).select("_test", "n.d", F.col("n._train").alias("_train")))
    found = pairs.join(asked.select(col(key).alias("_test"), at.alias("x")), "_test").join(train.select(col(key).alias("_train"), at.alias("y")), "_train")
    rows = found.select("_test", "d", "x", "y").toPandas().sort_values(["_test", "d"])
    if rows.empty:
        return Projections.drawn(len(features), 1, FIRST_TABLES, 1.0, PROBES, seed)
    last = rows.groupby("_test").d.max()
    apart = last[last > 0].median() if (last > 0).any() else 1.0
    width = WIDTHS * float(apart)
    x, y = np.stack(rows.x.to_numpy()), np.stack(rows.y.to_numpy())
    seen = np.array([r.x for r in _first_rows(train, key, TRAIN_SAMPLE).select(at.alias("x")).collect()])
    functions = _functions(seen, train.count(), width, seed)
    tables, trials = FIRST_TABLES, []
    while True:
        drawn = Projections.drawn(len(features), functions, tables, width, PROBES, seed)
        met = (drawn.visited(x).reshape(len(x), tables, -1) == drawn.own(y)[:, :, None]).any(axis=(1, 2))
        share = pd.Series(met, index=rows._test.to_numpy()).groupby(level=0).mean()
        error = float(share.std(ddof=0)) / np.sqrt(len(share))
        trials.append((tables, float(share.mean())))
        if share.mean() - 2 * error >= recall or tables >= MAX_TABLES:
            return Projections(drawn.directions, drawn.offsets, drawn.factors, drawn.salts, width, PROBES, float(share.mean()), trials)
        tables *= 2


def _functions(seen: np.ndarray, n: int, width: float, seed: int) -> int:
    """The fewest directions with which a training row shares its cell with ``CANDIDATES`` others, as the sample tells."""
    _, of, copies = np.unique(seen, axis=0, return_inverse=True, return_counts=True)
    weights = 1 / copies[of.ravel()]  # copies of a point count as one
    for functions in range(1, MAX_DIRECTIONS):
        keys = Projections.drawn(seen.shape[1], functions, 1, width, 0, seed).own(seen)[:, 0]
        _, cell = np.unique(keys, return_inverse=True)
        held = np.bincount(cell, weights)
        total = held.sum()
        shared = (held * (held - 1)).sum() / max(total * (total - 1), 1.0)
        if shared * n <= CANDIDATES:
            return functions
    return MAX_DIRECTIONS


def _with_buckets(df: DataFrame, keys) -> DataFrame:
    """One row per row and key that ``keys`` gives for its vector ``x``."""

    @F.pandas_udf("array<long>")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            parts = [keys(np.stack(x.iloc[s : s + ROWS_AT_ONCE].to_numpy())) for s in range(0, len(x), ROWS_AT_ONCE)]
            yield pd.Series([row for part in parts for row in part])

    return df.withColumn("bucket", F.explode(F.array_distinct(buckets("x"))))


def _crowded(df: DataFrame, block: int, name: str) -> DataFrame:
    """Buckets of more than ``block`` rows and the number of blocks they take."""
    sizes = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    return sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias(name))


def _meet(k: int):
    """The nearest training rows of each bucket's test rows, for all buckets of one part."""
    nearest = neighbors._block_neighbours(k)

    def find(key: tuple, test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        here, there = test.groupby("bucket").indices, train.groupby("bucket").indices
        parts = [nearest(key, test.iloc[at], train.iloc[there[b]]) for b, at in here.items() if b in there]
        return pd.concat(parts) if parts else nearest(key, test.iloc[:0], train.iloc[:0])

    return find


def approximate_neighbours(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5, recall: float = 0.95,
    projections: Projections | None = None,
) -> DataFrame:
    """(key, neighbours) as ``nearest_neighbours`` gives it; a true neighbour is met with probability ``recall``.

    ``key`` is unique in both tables, features are not null. Distances are exact, ties go to the smaller key. Every test row has
    min(k, training rows) neighbours.
    """
    plan = projections or fit_projections(train, test, features, label, key, k, recall)
    points, kept = settle(points_of(test, features, key)), settle(offers_of(train, features, label, key, k))
    probes, offers = _with_buckets(points, plan.visited), _with_buckets(kept, plan.own)
    # The lists of crowded buckets are short: at most one for each block of rows. Spark chooses how to join them.
    blocks = _crowded(probes, neighbors.TEST_BLOCK, "_as").join(_crowded(offers, neighbors.TRAIN_BLOCK, "_bs"), "bucket", "full")

    # Small buckets share a part, so that a part is worth a call; a crowded one has its parts to itself.
    n_train, tables = kept.count(), len(plan.directions)
    size = max(n_train * tables / neighbors.TRAIN_BLOCK, points.count() * tables * (plan.probes + 1) / neighbors.TEST_BLOCK)
    n_parts = max(1, math.ceil(size))

    def cut(df: DataFrame, own: str, mine: str, its: str, here: str, there: str) -> DataFrame:
        n, m = F.coalesce(mine, F.lit(1)), F.coalesce(its, F.lit(1))
        block = F.pmod(digest_prefix(digest(F.col(own)), 8), n).cast("int")
        crowded = F.col("_as").isNotNull() | F.col("_bs").isNotNull()
        part = F.when(crowded, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(n_parts)))
        return df.join(blocks, "bucket", "left").select(
            *df.columns, crowded.alias("crowded"), part.alias("part"), block.alias(here), F.explode(F.sequence(F.lit(0), m - 1)).alias(there)
        )

    probes, offers = cut(probes, "_test", "_as", "_bs", "a", "b"), cut(offers, "_train", "_bs", "_as", "b", "a")
    kinds = {"t": probes.schema["_test"].dataType.simpleString(), "s": offers.schema["_train"].dataType.simpleString()}
    met = (
        probes.groupBy("crowded", "part", "a", "b")
        .cogroup(offers.groupBy("crowded", "part", "a", "b"))
        .applyInPandas(_meet(k), f"_test {kinds['t']}, d double, _train {kinds['s']}, label double")
    )
    near = F.slice(F.array_sort(F.collect_set(F.struct("d", "_train", "label"))), 1, k)
    found = settle(met.groupBy("_test").agg(near.alias("neighbours")))
    enough = found.where(F.size("neighbours") >= min(k, n_train))
    lacking = settle(points.join(enough.select("_test"), "_test", "left_anti"))
    if not lacking.isEmpty():
        left = lacking.select("_test", *[F.col("x")[i].alias(f) for i, f in enumerate(features)])
        exact = nearest_neighbours(train.withColumnRenamed(key, "_train"), left.withColumnRenamed("_test", "_train"), features, label, "_train", k)
        enough = enough.unionByName(exact.withColumnRenamed("_train", "_test"))
    return for_every_row(test, features, key, points, enough)


def lsh_classifier(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5, prediction: str = "prediction",
    recall: float = 0.95,
) -> DataFrame:
    """``test`` with the majority label of k near training rows, the smallest of several."""
    return vote(test, approximate_neighbours(train, test, features, label, key, k, recall), key, prediction)
