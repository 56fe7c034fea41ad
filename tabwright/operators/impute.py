"""Imputation of missing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import hash_uniform
from ..plans.ranks import exact_quantiles, order_buckets
from ..plans.scalars import col, scalar_row, unpivot
from .coltypes import numeric_columns, present, string_columns


def _filled(df: DataFrame, fills: dict[str, Column]) -> DataFrame:
    return df.select(
        *[
            F.when(present(df, c), col(c)).otherwise(fills[c]).alias(c) if c in fills else col(c)
            for c in df.columns
        ]
    )


def impute_mean(df: DataFrame, cols: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Null and NaN become the column mean, of ``fit_on`` if given."""
    cols = cols or numeric_columns(df)
    source = fit_on if fit_on is not None else df
    means = scalar_row(source, **{c: F.avg(F.when(present(source, c), col(c))) for c in cols})
    return _filled(df, means)


def impute_median(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Null and NaN become the median: exact, or from a sketch in one pass."""
    cols = cols or numeric_columns(df)
    numbers = df.select(*[F.when(present(df, c), col(c).cast("double")).alias(c) for c in cols])
    if approximate:
        return _filled(df, scalar_row(numbers, **{c: F.percentile_approx(col(c), 0.5) for c in cols}))
    medians = exact_quantiles(numbers, cols, [0.5])
    return _filled(df, {c: F.lit(v[0]).cast("double") for c, v in medians.items()})


def impute_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null becomes the most frequent value, the smallest of several; ``Unknown`` if there is none."""
    cols = cols or string_columns(df)
    counts = unpivot(df, cols).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    modes = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))
    # One entry per column.
    table = modes.agg(F.map_from_entries(F.collect_list(F.struct("column", "mode"))).alias("modes")).scalar()
    return _filled(df, {c: F.coalesce(F.try_element_at(table, F.lit(c)), F.lit("Unknown")) for c in cols})


def _fill_along(df: DataFrame, cols: list[str] | None, order_by: list[str], partition_by: list[str] | None, back: bool) -> DataFrame:
    cols = cols or [c for c in df.columns if c not in order_by and c not in (partition_by or [])]
    by = [col(b) for b in partition_by or []]
    value = {c: F.when(present(df, c), col(c)) for c in cols}
    staged = order_buckets(df, order_by)
    order = F.struct(*[col(c) for c in order_by])
    nearest = F.min_by if back else F.max_by
    edges = staged.groupBy(*by, "_bucket").agg(
        *[nearest(value[c], F.when(value[c].isNotNull(), order)).alias(f"_edge{i}") for i, c in enumerate(cols)]
    )

    def direction(c: Column) -> Column:
        return c.desc() if back else c.asc()

    # Filling back reads the rows in reverse: a frame that only grows costs one step per row.
    outside = W.partitionBy(*by).orderBy(direction(F.col("_bucket"))).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        *[b.alias(f"_by{i}") for i, b in enumerate(by)],
        F.col("_bucket").alias("_b"),
        *[F.last(f"_edge{i}", True).over(outside).alias(f"_carry{i}") for i in range(len(cols))],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*[direction(col(c)) for c in order_by])
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = staged.select("*", *[F.last(value[c], True).over(inside).alias(f"_near{i}") for i, c in enumerate(cols)])
    condition = F.col("_b") == F.col("_bucket")
    for i, b in enumerate(by):
        condition = condition & F.col(f"_by{i}").eqNullSafe(b)
    place = {c: i for i, c in enumerate(cols)}
    return local.join(carried, condition).select(
        *[
            F.coalesce(F.col(f"_near{place[c]}"), F.col(f"_carry{place[c]}")).alias(c) if c in place else col(c)
            for c in df.columns
        ]
    )


def fill_forward(df: DataFrame, cols: list[str] | None, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Null becomes the last earlier value in ``order_by``, all columns by default.

    Windows run inside ordered buckets; each bucket receives the last value before it.
    """
    return _fill_along(df, cols, order_by, partition_by, back=False)


def fill_backward(df: DataFrame, cols: list[str] | None, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Null becomes the next later value in ``order_by``."""
    return _fill_along(df, cols, order_by, partition_by, back=True)


def proportion_table(df: DataFrame, name: str) -> DataFrame:
    """(category, cnt, share) of the non-null values."""
    n = scalar_row(df, n=F.count(col(name)))["n"]
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("category")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("category", "cnt", (F.col("cnt") / n).alias("share"))


def impute_proportional(df: DataFrame, name: str, key: str, seed: int = 42) -> DataFrame:
    """Null becomes a category drawn by observed share; ``key`` (unique) and ``seed`` fix the draw.

    Categories lie end to end on 0..n in hash order. The line is cut into cells; a draw meets only
    the categories that touch its cell, so the join is an equi join with a few candidates per row.
    """
    counts = proportion_table(df, name).withColumn("_digest", F.md5(F.col("category").cast("string")))
    counts = counts.withColumn("_part", F.substring("_digest", 1, 3))
    totals = counts.groupBy("_part").agg(F.sum("cnt").alias("_in_part"))
    offsets = totals.select(
        "_part", (F.sum("_in_part").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_in_part")).alias("_offset")
    )
    inside = W.partitionBy("_part").orderBy("_digest", "category").rowsBetween(W.unboundedPreceding, 0)
    spans = counts.withColumn("_high", F.sum("cnt").over(inside)).join(offsets, "_part").select(
        "category",
        (F.col("_offset") + F.col("_high") - F.col("cnt")).alias("_low"),
        (F.col("_offset") + F.col("_high")).alias("_high"),
    )
    size = scalar_row(df, n=F.count(col(name)))["n"]
    cells = F.greatest(
        F.lit(1024), scalar_row(df, k=F.approx_count_distinct(col(name)))["k"]
    ).cast("double")

    def cell(position: Column) -> Column:
        return F.floor(position / size * cells)

    touched = spans.select("*", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1))).alias("_cell"))
    # Only the missing rows take part in the join.
    missing = df.where(col(name).isNull()).withColumn(
        "_draw", F.floor(hash_uniform(col(key), seed) * size)
    ).withColumn("_cell", cell(F.col("_draw")))
    hit = (F.col("_draw") >= F.col("_low")) & (F.col("_draw") < F.col("_high"))
    # A column without any value has no spans: its rows stay null.
    drawn = missing.join(touched, (missing["_cell"] == touched["_cell"]) & hit, "left").select(
        *[F.col("category").alias(c) if c == name else col(c) for c in df.columns]
    )
    return df.where(col(name).isNotNull()).unionByName(drawn)


def impute_features_mean(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Mean fill of model inputs; pass the training rows as ``fit_on`` to keep test rows out of the mean."""
    return impute_mean(df, features, fit_on)
