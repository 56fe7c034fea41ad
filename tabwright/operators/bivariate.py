"""Two-variable analyses: regression, correlation, one-way ANOVA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hash_uniform
from ..functions.normal import f_upper_tail
from ..functions.numbers import as_double
from ..plans.scalars import col, scalar_row
from .coltypes import coerce_all_numeric

MIN_PAIRS = 3
SIGNIFICANT = 0.05
#: Rows whose matrices are multiplied at once, and matrices of one column that are merged in one place.
BATCH, FAN_IN = 8192, 64
#: A centred square sum below this share of the plain one has lost too many digits.
LOST = 1e-6
PAIR_ARRAYS = ("n", "mean", "other", "square", "other_square", "cross")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.select(
        as_double(col(x), df.schema[x].dataType).alias("x"), as_double(col(y), df.schema[y].dataType).alias("y")
    )
    return both.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2, equation; no row below three pairs."""
    fit = _pairs(df, x, y).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )
    equation = F.format_string("Y = %.4f + %.4f*X", "intercept", "slope")
    return fit.where(F.col("n") >= MIN_PAIRS).withColumn("equation", equation)


def regression_line(df: DataFrame, x: str, y: str, n: int = 100) -> DataFrame:
    """(point, x, y): the fitted line on an even grid over the range of x."""
    fit = scalar_row(
        _pairs(df, x, y), a=F.regr_intercept("y", "x"), b=F.regr_slope("y", "x"), low=F.min("x"), high=F.max("x")
    )
    at = fit["low"] + F.col("id") * (fit["high"] - fit["low"]) / (n - 1)
    return df.sparkSession.range(n).select(F.col("id").alias("point"), at.alias("x"), (fit["a"] + fit["b"] * at).alias("y"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over the complete pairs; null where one side is constant."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b)))


class PairMoments:
    """Moments of every pair of columns over the rows that hold both, as square arrays.

    ``n[i, j]`` rows hold i and j; over these, ``mean[i, j]`` and ``square[i, j]`` are mean and centred square sum of i, ``cross`` the centred
    products. Two sets merge without losing digits to large means.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, cross: np.ndarray):
        self.n, self.mean, self.square, self.cross = n, mean, square, cross

    @staticmethod
    def of(x: np.ndarray) -> PairMoments:
        """The moments of a matrix of rows; NaN marks a gap."""
        held = ~np.isnan(x)
        mask = held.astype(float)
        count = np.maximum(mask.sum(axis=0), 1)
        filled = np.where(held, x, 0.0)
        # A value near the mean is taken off, one that occurs, so that a constant column leaves zeros.
        near = np.where(held, np.abs(x - filled.sum(axis=0) / count), np.inf).argmin(axis=0)
        start = filled[near, np.arange(x.shape[1])]
        moved = np.where(held, x - start, 0.0)
        n = mask.T @ mask
        total, square, cross = moved.T @ mask, (moved**2).T @ mask, moved.T @ moved
        rows = np.maximum(n, 1)
        mean, centred, cross = start[:, None] + total / rows, square - total**2 / rows, cross - total * total.T / rows
        # Where i lies far from that value on the rows that hold j, digits are lost: such a pair is computed by itself.
        for i, j in np.argwhere((square > 0) & (centred <= LOST * square)):
            both = held[:, i] & held[:, j]
            a, b = x[both, i], x[both, j]
            mean[i, j] = a[0] if a.min() == a.max() else a.mean()
            centred[i, j] = ((a - mean[i, j]) ** 2).sum()
            cross[i, j] = cross[j, i] = ((a - mean[i, j]) * (b - b.mean())).sum()
        return PairMoments(n, mean, centred, cross)

    def merge(self, other: PairMoments) -> PairMoments:
        n = self.n + other.n
        rows = np.maximum(n, 1)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        weight = self.n * other.n / rows
        mean = np.where(self.n > 0, self.mean + apart * other.n / rows, other.mean)
        return PairMoments(n, mean, self.square + other.square + apart**2 * weight, self.cross + other.cross + apart * apart.T * weight)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair moments of a task's rows, one row for each column with the columns from it on."""
    found = None
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            piece = batch.slice(start, BATCH)
            own = PairMoments.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in piece.columns]))
            found = own if found is None else found.merge(own)
    if found is not None:
        rows = [
            [i, *(v.tolist() for v in (found.n[i, i:], found.mean[i, i:], found.mean[i:, i], found.square[i, i:], found.square[i:, i], found.cross[i, i:]))]
            for i in range(len(found.n))
        ]
        kinds = [pa.int32()] + [pa.list_(pa.float64())] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["i", *PAIR_ARRAYS])


def _merge_pair_rows(group: pd.DataFrame) -> pd.DataFrame:
    """One row for a column's moments, from those of several tasks."""
    rows = sorted(group[list(PAIR_ARRAYS)].itertuples(index=False), key=lambda r: tuple(r.n) + tuple(r.mean))
    n, mean, other, square, other_square, cross = (np.array(rows[0][k], float) for k in range(6))
    for r in rows[1:]:
        m, at, other_at, *rest = (np.array(v, float) for v in r)
        total = np.maximum(n + m, 1)
        both = (n > 0) & (m > 0)
        d, e = np.where(both, at - mean, 0.0), np.where(both, other_at - other, 0.0)
        w = n * m / total
        square, other_square, cross = square + rest[0] + d * d * w, other_square + rest[1] + e * e * w, cross + rest[2] + d * e * w
        mean, other = np.where(n > 0, mean + d * m / total, at), np.where(n > 0, other + e * m / total, other_at)
        n = n + m
    return pd.DataFrame({"i": [group["i"].iloc[0]], **{k: [v] for k, v in zip(PAIR_ARRAYS, (n, mean, other, square, other_square, cross))}})


def correlation_matrix(df: DataFrame) -> DataFrame:
    """(a, b, r) for every ordered pair of numeric columns, strings coerced, pairwise complete; null where one side is constant.

    One scan for any number of columns: a task reduces its rows to matrices by matrix products, and rows of these matrices are merged.
    """
    numbers = coerce_all_numeric(df)
    names = numbers.columns
    if len(names) < 2:
        raise ValueError("correlation needs two numeric columns")
    p = len(names)
    schema = "i int, " + ", ".join(f"{k} array<double>" for k in PAIR_ARRAYS)
    # A table without rows has all pairs, too.
    none = df.sparkSession.range(p).select(
        F.col("id").cast("int").alias("i"), *[F.array_repeat(F.lit(0.0), (p - F.col("id")).cast("int")).alias(k) for k in PAIR_ARRAYS]
    )
    local = numbers.mapInArrow(_pair_rows, schema).unionByName(none).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    few = local.groupBy("i", "slot").applyInPandas(lambda g: _merge_pair_rows(g.drop(columns="slot")), schema)
    merged = few.groupBy("i").applyInPandas(_merge_pair_rows, schema)
    cells = merged.select("i", F.posexplode(F.arrays_zip(*PAIR_ARRAYS)).alias("j", "m"))

    r = F.when((F.col("m.square") > 0) & (F.col("m.other_square") > 0), F.try_divide("m.cross", F.sqrt("m.square") * F.sqrt("m.other_square")))
    name = F.array(*[F.lit(c) for c in names])
    a, b = F.element_at(name, F.col("i") + 1), F.element_at(name, F.col("i") + F.col("j") + 1)
    found = cells.select(a.alias("a"), b.alias("b"), r.alias("r"))
    both_ways = F.explode(F.array_distinct(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))))
    return found.select(both_ways.alias("p")).select("p.a", "p.b", "p.r")


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    # The caller sends one row.
    return pd.Series([f_upper_tail(*row) for row in zip(f, d1, d2)])


def anova_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, n, f, p, significant; null groups and values are left out."""
    rows = df.select(as_double(col(value), df.schema[value].dataType).alias("x"), col(group).alias("g"))
    # Tasks combine first, so a group that holds most rows costs one partial row per task.
    groups = rows.where("x is not null and g is not null").groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    total = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    mean = scalar_row(groups, m=F.sum(F.col("n") * F.col("m")) / F.sum("n"))["m"]
    between = scalar_row(groups, b=F.sum(F.col("n") * F.pow(F.col("m") - mean, F.lit(2))))["b"]
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    scored = total.where(F.col("groups") >= 2).select(
        "groups", "n", F.try_divide(between / d1, F.col("within") / d2).alias("f"), d1.cast("double").alias("_d1"), d2.cast("double").alias("_d2")
    )
    return scored.withColumn("p", F.when(F.col("f").isNotNull(), _f_tail("f", "_d1", "_d2"))).select(
        "groups", "n", "f", "p", (F.col("p") < SIGNIFICANT).alias("significant")
    )


def scatter_sample(df: DataFrame, x: str, y: str, key: str, rate: float, seed: int = 42) -> DataFrame:
    """Points for a scatter: a hash sample of the complete pairs at a fixed rate."""
    kept = df.where(hash_uniform(col(key), seed) < rate)
    return _pairs(kept, x, y)
