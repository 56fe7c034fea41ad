"""Descriptive statistics and the data behind distribution charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import as_double
from ..plans.ranks import exact_quantiles, value_ranks
from ..plans.scalars import col, scalar_row, unpivot
from .coltypes import numeric_columns, present, string_columns

QUARTILES = [0.25, 0.5, 0.75]
FENCE = 1.5
KERNEL_REACH = 9.0  # a Gaussian beyond 9 bandwidths is below double precision


def numbers_of(df: DataFrame, *names: str) -> DataFrame:
    """The columns as doubles; text is parsed, NaN becomes null."""
    return df.select(*[as_double(col(c), df.schema[c].dataType).alias(c) for c in names])


def describe(df: DataFrame) -> DataFrame:
    """Per numeric column: count, mean, std, min, quartiles, max.

    A table without numeric columns gets count, unique, top and freq per string column.
    """
    names = numeric_columns(df)
    if not names:
        return _describe_text(df)
    numbers = numbers_of(df, *names)
    quartiles = exact_quantiles(numbers, names, QUARTILES)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(col(c)).alias("count"),
            F.avg(col(c)).alias("mean"),
            F.stddev_samp(col(c)).alias("std"),
            F.min(col(c)).alias("min"),
            *[F.lit(v).cast("double").alias(a) for a, v in zip(("q25", "q50", "q75"), quartiles[c])],
            F.max(col(c)).alias("max"),
        )
        for c in names
    ]
    return numbers.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _describe_text(df: DataFrame) -> DataFrame:
    counts = (
        unpivot(df, string_columns(df)).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts.groupBy("column").agg(
        F.sum("cnt").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").alias("freq"),
    )


def numeric_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: mean, median, std, min, q1, q3, max, skewness, kurtosis (population, excess)."""
    numbers = numbers_of(df, name)
    q1, median, q3 = exact_quantiles(numbers, [name], QUARTILES)[name]
    x = col(name)
    return numbers.agg(
        F.avg(x).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.lit(q1).cast("double").alias("q1"),
        F.lit(q3).cast("double").alias("q3"),
        F.max(x).alias("max"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
    )


def numeric_summary_full(df: DataFrame, name: str) -> DataFrame:
    """``numeric_summary`` with count, IQR, range and missing."""
    tallies = scalar_row(
        numbers_of(df, name), count=F.count(col(name)), missing=F.count_if(col(name).isNull())
    )
    return numeric_summary(df, name).select(
        tallies["count"].alias("count"),
        "*",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("max") - F.col("min")).alias("range"),
        tallies["missing"].alias("missing"),
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, cnt) of the non-null values."""
    return df.where(present(df, name)).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def _present_total(df: DataFrame, name: str) -> Column:
    return scalar_row(df, n=F.count_if(present(df, name)))["n"]


def categorical_summary(df: DataFrame, name: str) -> DataFrame:
    """One row: total, unique, most common value and its count, missing."""
    levels = df.select(F.when(present(df, name), col(name)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    v, cnt, real = F.col("v"), F.col("cnt"), F.col("v").isNotNull()
    return levels.agg(
        F.coalesce(F.sum(F.when(real, cnt)), F.lit(0)).alias("total"),
        F.count(v).alias("unique"),
        F.min_by(v, F.when(real, F.struct(-cnt, v))).alias("most_common"),
        F.max(F.when(real, cnt)).alias("most_common_count"),
        F.coalesce(F.sum(F.when(~real, cnt)), F.lit(0)).alias("missing"),
    )


def frequency_table(df: DataFrame, name: str) -> DataFrame:
    """(value, cnt, pct, bar), most frequent first, ties by value."""
    pct = F.round(F.col("cnt") / _present_total(df, name) * 100, 2)
    return (
        value_counts(df, name)
        .withColumn("pct", pct)
        .withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("pct") / 2).cast("int")))
        .orderBy(F.desc("cnt"), "value")
    )


def top_values(df: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The n most frequent values with their share of the non-null values."""
    total = _present_total(df, name)
    return (
        value_counts(df, name)
        .orderBy(F.desc("cnt"), "value")
        .limit(n)
        .withColumn("pct", F.round(F.col("cnt") / total * 100, 2))
    )


def top_with_others(df: DataFrame, name: str, whole: int = 10, keep: int = 5) -> DataFrame:
    """All values when there are at most ``whole``; otherwise the first ``keep`` and ``Others``."""
    leaders = value_counts(df, name).orderBy(F.desc("cnt"), "value").limit(whole + 1)
    # At most eleven rows are left for this window.
    every = W.partitionBy(F.lit(0))
    ranked = leaders.select(
        F.col("value").cast("string").alias("value"),
        "cnt",
        F.row_number().over(every.orderBy(F.desc("cnt"), "value")).alias("_place"),
        F.count(F.lit(1)).over(every).alias("_k"),
    )
    kept = ranked.where((F.col("_k") <= whole) | (F.col("_place") <= keep)).select("value", "cnt")
    rest = kept.agg((_present_total(df, name) - F.sum("cnt")).alias("cnt")).where("cnt > 0")
    return kept.unionByName(rest.select(F.lit("Others").alias("value"), "cnt"))


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, cnt): equal-width bins over [min, max], the last closed on the right."""
    numbers = numbers_of(df, name)
    x = col(name)
    ends = scalar_row(numbers, low=F.min(x), high=F.max(x))
    flat = ends["low"] == ends["high"]
    low = F.when(flat, ends["low"] - 0.5).otherwise(ends["low"])
    width = F.when(flat, F.lit(1.0)).otherwise(ends["high"] - ends["low"]) / bins
    filled = (
        numbers.where(x.isNotNull())
        .groupBy(F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce(F.col("cnt"), F.lit(0)).alias("cnt"),
    )


def box_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: q1, median, q3, whiskers at data points, number of fliers."""
    numbers = numbers_of(df, name)
    x = col(name)
    q1, median, q3 = (F.lit(v).cast("double") for v in exact_quantiles(numbers, [name], QUARTILES)[name])
    low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
    inside = (x >= low) & (x <= high)
    return numbers.agg(
        q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(x.isNotNull() & ~inside).alias("fliers"),
    )


def rank_value(rank: Column, value: Column) -> Column:
    """Aggregate over ``value_ranks`` rows: the value at a 0-based position."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt")), value))


def rank_quantile(p: float, value: Column) -> Column:
    """Aggregate over ``value_ranks`` rows: the linear-interpolation quantile."""
    spot = F.lit(p) * (F.col("total") - 1)
    low, high = rank_value(F.floor(spot), value), rank_value(F.ceil(spot), value)
    return low + (F.max(spot) - F.floor(F.max(spot))) * (high - low)


def box_stats_by_group(df: DataFrame, name: str, group: str) -> DataFrame:
    """``box_stats`` per non-null group; a group may hold most of the table."""
    numbers = df.select(col(group).alias("group"), as_double(col(name), df.schema[name].dataType).alias("x"))
    ranked = value_ranks(numbers.where(F.col("group").isNotNull()), "x", ["group"])
    x = F.col("x")
    quartiles = ranked.groupBy("group").agg(
        *[rank_quantile(p, x).alias(a) for p, a in zip(QUARTILES, ("q1", "median", "q3"))]
    )
    spread = F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - FENCE * spread) & (x <= F.col("q3") + FENCE * spread)
    return (
        ranked.join(quartiles, "group")
        .groupBy("group", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).alias("fliers"),
        )
    )


def density_curve(df: DataFrame, name: str, points: int = 1000) -> DataFrame:
    """(x, density): Gaussian kernel estimate with Scott's bandwidth n^(-1/5)·std.

    The grid spans the data range widened by half on both sides. Each distinct value adds to the
    grid points within nine bandwidths only; the grid is the group key, so tasks combine first.
    """
    numbers = numbers_of(df, name)
    v = col(name)
    facts = scalar_row(numbers, n=F.count(v), sd=F.stddev_samp(v), low=F.min(v), high=F.max(v))
    width = facts["high"] - facts["low"]
    start = facts["low"] - width / 2
    step = width * 2 / (points - 1)
    h = facts["sd"] * F.pow(facts["n"].cast("double"), F.lit(-0.2))

    def position(at: Column) -> Column:
        return ((at - start) / step).cast("bigint")

    levels = numbers.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    near = levels.select(
        "v", "cnt",
        F.explode(
            F.sequence(
                F.greatest(position(F.col("v") - KERNEL_REACH * h), F.lit(0)),
                F.least(position(F.col("v") + KERNEL_REACH * h) + 1, F.lit(points - 1)),
            )
        ).alias("i"),
    )
    u = (start + F.col("i") * step - F.col("v")) / h
    sums = near.groupBy("i").agg(F.sum(F.col("cnt") * F.exp(-u * u / 2)).alias("_sum"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i"))
    scale = facts["n"] * h * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(sums, "i", "left").select(
        F.col("i").alias("point"),
        (start + F.col("i") * step).alias("x"),
        (F.coalesce(F.col("_sum"), F.lit(0.0)) / scale).alias("density"),
    )


def high_cardinality_warning(df: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """One row: (column, n_unique, high_cardinality)."""
    return df.agg(F.count_distinct(F.when(present(df, name), col(name))).alias("n_unique")).select(
        F.lit(name).alias("column"), "n_unique", (F.col("n_unique") > limit).alias("high_cardinality")
    )
