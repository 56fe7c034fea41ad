"""Normality tests, transform advice and transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normal import log_upper_tail, quantile_sql, upper_tail
from ..functions.numbers import as_double
from ..plans.ranks import value_ranks
from ..plans.scalars import col, scalar_row, spread
from .describe import numbers_of

ALPHA = 0.05
RELIABLE_UP_TO = 5000
CHUNK = 65_536

# Royston 1995 (AS R94), polynomials in 1/sqrt(n), in n and in ln(n), lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]

# Ranked advice per shape of the distribution.
ADVICE = {
    "extreme_positive": [("Log", "best"), ("Box-Cox", "good"), ("Yeo-Johnson", "ok")],
    "extreme_any": [("Yeo-Johnson", "only"), ("Box-Cox", "cannot use")],
    "skewed_positive": [("Square Root", "best"), ("Log", "good"), ("Yeo-Johnson", "ok")],
    "skewed_any": [("Yeo-Johnson", "best")],
    "mild": [("Z-Score", "best"), ("Min-Max", "ok")],
}


class TransformError(ValueError):
    """The data do not meet the precondition of a transform."""


def _poly(coefficients: list[float], x: Column) -> Column:
    total = F.lit(0.0)
    for value in reversed(coefficients):
        total = total * x + F.lit(value)
    return total


def rank_rows(ranked: DataFrame, value: str) -> DataFrame:
    """One row per rank: (value, rank 0.., total) from ``value_ranks``.

    Runs of equal values are cut into chunks that are spread again before the ranks come out.
    """
    last = F.col("before") + F.col("cnt")
    chunks = ranked.select(
        col(value), "total", last.alias("_last"), F.explode(F.sequence(F.col("before"), last - 1, F.lit(CHUNK))).alias("_from")
    ).repartition("_from")
    upto = F.least(F.col("_from") + CHUNK, F.col("_last")) - 1
    return chunks.select(col(value), "total", F.explode(F.sequence(F.col("_from"), upto)).alias("rank"))


def shapiro_wilk(df: DataFrame, name: str) -> DataFrame:
    """One row: n, w, p, normal, p_reliable (n ≤ 5000). Null for n < 6.

    The weights are a formula of rank and n, so W is one aggregate over the ranks.
    """
    ranked = value_ranks(numbers_of(df, name), name)
    x = col(name)
    rows = rank_rows(ranked, name).withColumn("_m", F.expr(quantile_sql("(rank+0.625e0)/(total+0.25e0)")))
    centre = scalar_row(ranked, mean=F.sum(x * F.col("cnt")) / F.sum("cnt"))["mean"]
    n = F.col("total")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, x))

    sums = rows.groupBy("total").agg(
        F.sum(F.col("_m") * (x - centre)).alias("mx"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum((x - centre) * (x - centre)).alias("ss"),
        F.max(F.when(F.col("rank") == n - 1, F.col("_m"))).alias("m_n"),
        F.max(F.when(F.col("rank") == n - 2, F.col("_m"))).alias("m_n1"),
        (at(n - 1) - at(F.lit(0))).alias("outer"),
        (at(n - 2) - at(F.lit(1))).alias("inner"),
    )
    u = F.lit(1.0) / F.sqrt(n)
    root = F.sqrt("mm")
    a_n = F.col("m_n") / root + _poly(LAST_WEIGHT, u)
    a_n1 = F.col("m_n1") / root + _poly(NEXT_WEIGHT, u)
    eps = (F.col("mm") - 2 * F.pow("m_n", F.lit(2)) - 2 * F.pow("m_n1", F.lit(2))) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1)
    middle = (F.col("mx") - F.col("m_n") * F.col("outer") - F.col("m_n1") * F.col("inner")) / F.sqrt(eps)
    w = F.pow(middle + a_n * F.col("outer") + a_n1 * F.col("inner"), F.lit(2)) / F.col("ss")
    scored = sums.where("total >= 6 and ss > 0").select(n.alias("n"), F.least(w, F.lit(1.0)).alias("w"))
    size = F.col("n").cast("double")
    logs = F.ln(size)
    gap = F.ln(1 - F.col("w"))
    small = (-F.ln(_poly(SMALL_GAMMA, size) - gap) - _poly(SMALL_MEAN, size)) / F.exp(_poly(SMALL_LOG_SD, size))
    large = (gap - _poly(LARGE_MEAN, logs)) / F.exp(_poly(LARGE_LOG_SD, logs))
    return scored.withColumn("_z", F.when(F.col("n") < 12, small).otherwise(large)).select(
        "n", "w", upper_tail("_z").alias("p"),
        (upper_tail("_z") > ALPHA).alias("normal"),
        (F.col("n") <= RELIABLE_UP_TO).alias("p_reliable"),
    )


def anderson_darling(df: DataFrame, name: str) -> DataFrame:
    """One row: n and A² against the normal with the sample mean and standard deviation.

    The rank weights of a run of equal values have a closed form, so the sum runs over distinct values.
    """
    numbers = numbers_of(df, name)
    facts = scalar_row(numbers, mean=F.avg(col(name)), sd=F.stddev_samp(col(name)))
    ranked = value_ranks(numbers, name).withColumn("_z", (col(name) - facts["mean"]) / facts["sd"]).withColumn("_minus", -F.col("_z"))
    n, low = F.col("total").cast("double"), F.col("before").cast("double")
    high = low + F.col("cnt")
    left = (high * high - low * low) * log_upper_tail("_minus")
    right = ((n - low) * (n - low) - (n - high) * (n - high)) * log_upper_tail("_z")
    return ranked.groupBy("total").agg(F.sum((left + right) / n).alias("_sum")).select(
        F.col("total").alias("n"), (-n - F.col("_sum")).alias("a2")
    )


def normality_report(df: DataFrame, name: str) -> DataFrame:
    """One row: n, w, p, a2, skewness, kurtosis, normal."""
    shape = scalar_row(numbers_of(df, name), skew=F.skewness(col(name)), kurt=F.kurtosis(col(name)))
    return shapiro_wilk(df, name).join(anderson_darling(df, name), "n").select(
        "n", "w", "p", "a2", shape["skew"].alias("skewness"), shape["kurt"].alias("kurtosis"), "normal", "p_reliable"
    )


def recommend_transform(df: DataFrame, name: str) -> DataFrame:
    """(place, method, rating, skewness): transforms ranked by skewness and sign."""
    x = col(name)
    facts = numbers_of(df, name).agg(
        F.abs(F.skewness(x)).alias("skewness"), F.coalesce(F.bool_or(x <= 0), F.lit(False)).alias("_blocked")
    )
    shape = (
        F.when(F.col("skewness") > 2, F.when(F.col("_blocked"), "extreme_any").otherwise("extreme_positive"))
        .when(F.col("skewness") > 1, F.when(F.col("_blocked"), "skewed_any").otherwise("skewed_positive"))
        .otherwise("mild")
    )
    rows = [
        F.struct(F.lit(s).alias("s"), F.lit(i + 1).alias("place"), F.lit(m).alias("method"), F.lit(r).alias("rating"))
        for s, entries in ADVICE.items()
        for i, (m, r) in enumerate(entries)
    ]
    return facts.select("skewness", shape.alias("_shape"), F.inline(F.array(*rows))).where("s = _shape").select(
        "place", "method", "rating", "skewness"
    )


def _require(df: DataFrame, name: str, broken: Column, message: str) -> None:
    if df.agg(F.coalesce(F.bool_or(broken), F.lit(False))).first()[0]:
        raise TransformError(message)


def boxcox(x: Column, lam: Column | float) -> Column:
    lam = F.lit(lam)
    return F.when(lam == 0, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeojohnson(x: Column, lam: Column | float) -> Column:
    lam = F.lit(lam)
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def search_lambda(numbers: DataFrame, name: str, family: str, low: float = -2.0, high: float = 2.0, points: int = 41, passes: int = 3) -> float:
    """The power with the largest likelihood, to six decimals.

    One aggregate per grid, each grid within the best cell of the last, then a parabola.
    """
    x = col(name)
    numbers = spread(numbers)
    power, jacobian = (
        (boxcox, F.ln(x)) if family == "Box-Cox" else (yeojohnson, F.signum(x) * F.log1p(F.abs(x)))
    )
    n, logs = numbers.agg(F.count(x), F.sum(jacobian)).first()
    done = 0
    while True:
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        # Every task reduces its rows to one variance per grid point before the shuffle.
        tried = numbers.where(x.isNotNull()).select(x, F.posexplode(F.lit(grid)).alias("i", "lam"))
        rows = tried.groupBy("i").agg(F.var_pop(power(x, F.col("lam")))).orderBy("i").collect()
        variances = [r[1] for r in rows]
        if not n or not all(variances):
            raise TransformError("needs at least two different values")
        score = [-n / 2 * math.log(v) + (lam - 1) * logs for lam, v in zip(grid, variances)]
        best = max(range(points), key=score.__getitem__)
        if best in (0, points - 1) and done == 0:
            shift = (high - low) / 2 * (1 if best else -1)
            low, high = low + shift, high + shift
            continue
        done += 1
        if done == passes:
            if 0 < best < points - 1:
                a, b, c = score[best - 1 : best + 2]
                return round(grid[best] + step * (a - c) / (2 * (a - 2 * b + c)), 6)
            return round(grid[best], 6)
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]


def transform(df: DataFrame, name: str, method: str, out: str = "transformed") -> DataFrame:
    """The rows with a value in ``name`` and the transformed column ``out``.

    Raises ``TransformError`` if the values do not allow the method.
    """
    numbers = numbers_of(df, name)
    source = df.withColumn(out, as_double(col(name), df.schema[name].dataType)).where(F.col(out).isNotNull())
    x = F.col(out)
    if method == "Log":
        _require(numbers, name, col(name) <= 0, "Log needs positive values")
        result = F.ln(x)
    elif method == "Square Root":
        _require(numbers, name, col(name) < 0, "Square Root needs values of at least zero")
        result = F.sqrt(x)
    elif method == "Box-Cox":
        _require(numbers, name, col(name) <= 0, "Box-Cox needs positive values")
        result = boxcox(x, search_lambda(numbers, name, method))
    elif method == "Yeo-Johnson":
        result = yeojohnson(x, search_lambda(numbers, name, method))
    elif method == "Z-Score":
        facts = scalar_row(numbers, mean=F.avg(col(name)), sd=F.stddev_samp(col(name)))
        result = F.try_divide(x - facts["mean"], facts["sd"])
    elif method == "Min-Max":
        ends = scalar_row(numbers, low=F.min(col(name)), high=F.max(col(name)))
        result = F.try_divide(x - ends["low"], ends["high"] - ends["low"])
    else:
        raise ValueError(f"unknown transform {method}")
    return source.withColumn(out, result)


def qq_points(df: DataFrame, name: str, max_points: int = 1000) -> DataFrame:
    """(rank, theoretical, value, slope, intercept, r): ordered values against normal medians.

    The fit uses every row; the points are those at ``max_points`` evenly spaced ranks.
    """
    ranked = value_ranks(numbers_of(df, name), name)
    median = (
        "CASE WHEN rank=total-1 THEN pow(0.5e0,1e0/total) WHEN rank=0 THEN 1e0-pow(0.5e0,1e0/total)"
        " ELSE (rank+0.6825e0)/(total+0.365e0) END"
    )
    rows = rank_rows(ranked, name).withColumn("_p", F.expr(median)).withColumn("theoretical", F.expr(quantile_sql("_p")))
    x, q = col(name), F.col("theoretical")
    fit = scalar_row(rows, slope=F.regr_slope(x, q), intercept=F.regr_intercept(x, q), r=F.corr(x, q))
    thin = F.greatest(F.lit(1.0), (F.col("total") - 1) / (max_points - 1))
    # A rank stays if a grid position rounds to it.
    nearest = F.round(F.round(F.col("rank") / thin) * thin)
    return rows.where(nearest == F.col("rank")).select(
        "rank", "theoretical", x.alias("value"), *[fit[k].alias(k) for k in ("slope", "intercept", "r")]
    )
