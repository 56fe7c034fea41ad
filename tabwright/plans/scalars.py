"""Statistics of a whole table used inside other expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F


WIDE = 8  # more values than this are computed at once, since every use of a subquery is planned anew


def scalar_row(df: DataFrame, **aggregates: Column) -> dict[str, Column]:
    """Named aggregates of ``df`` as columns to use in other expressions, without a join.

    A few become scalar subqueries of the query that uses them; many become literals from one job.
    """
    if len(aggregates) > WIDE:
        packed = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
        values = packed.first()
        return {f.name: F.lit(values[f.name]).cast(f.dataType) for f in packed.schema}
    row = df.agg(F.struct(*[expr.alias(name) for name, expr in aggregates.items()]).alias("row")).scalar()
    return {name: row[name] for name in aggregates}


def unpivot(df: DataFrame, cols: list[str], *ids: str) -> DataFrame:
    """(ids…, column, value), one row per cell; the columns must share one type."""
    return df.unpivot([F.col(quoted(i)) for i in ids], [F.col(quoted(c)) for c in cols], "column", "value")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that one small file would leave to a single task.

    Large tables already have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def shared(df: DataFrame, rows_per_task: int | None = None) -> Iterator[DataFrame]:
    """Keep a table for several passes.

    With ``rows_per_task`` a small table is read by few tasks, so that many short jobs stay short.
    """
    kept = df.persist()
    try:
        yield kept.coalesce(max(1, math.ceil(kept.count() / rows_per_task))) if rows_per_task else kept
    finally:
        kept.unpersist()
