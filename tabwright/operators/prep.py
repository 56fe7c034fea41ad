"""Model preparation: inputs, splits, scaling, feature engineering, outliers, augmentation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import digest, hash_uniform
from ..plans.ranks import exact_quantiles, number_rows
from ..plans.scalars import col, scalar_row
from ..session import settle
from .bivariate import safe_corr
from .coltypes import factorize, is_numeric, is_string, numeric_columns, present
from .quality import duplicate_count, missing_totals

OUTLIER_Z = 3.0


@dataclass
class Prepared:
    """Model inputs: features as doubles and a ``label`` column."""

    df: DataFrame
    features: list[str]
    dropped: list[str] = field(default_factory=list)


def prepare_xy(df: DataFrame, target: str, features: list[str], order_by: list[str]) -> Prepared:
    """Numeric features and a numeric label.

    A string target becomes codes by first appearance. Without any numeric feature the string
    features become codes; otherwise they are dropped and listed in ``dropped``.
    """
    if target != "label" and "label" in df.columns and "label" not in features + order_by:
        df = df.drop("label")  # its name is needed
    if is_string(df.schema[target].dataType):
        df = factorize(df, target, order_by, "label")
    else:
        df = df.withColumn("label", col(target).cast("double"))
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    dropped = [c for c in features if c not in numeric]
    if not numeric:
        for c in features:
            df = factorize(df, c, order_by, f"_code_{c}").drop(c).withColumnRenamed(f"_code_{c}", c)
        numeric, dropped = list(features), []
    keep = [c for c in order_by if c not in numeric]
    return Prepared(
        df.select(
            *[col(c) for c in keep], *[col(c).cast("double").alias(c) for c in numeric], F.col("label").cast("double").alias("label")
        ),
        numeric,
        dropped,
    )


def with_test_flag(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, digits: int = 4) -> DataFrame:
    """Add ``is_test``: true for exactly ceil(n·test_size) rows, those first in hash order of the key.

    Rows do not move. Bucket counts give the bucket where the test set ends; only that bucket, one
    row in ``16**digits``, is ranked.
    """
    hexed = digest(col(key), seed)
    # Hex text sorts like its number.
    bucket = F.substring(hexed, 1, digits)
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    whole = W.partitionBy(F.lit(0))
    wanted = F.ceil(F.sum("c").over(whole) * F.lit(test_size).cast("decimal(10,6)")).cast("bigint")
    running = counts.select("b", F.sum("c").over(whole.orderBy("b")).alias("upto"), "c", wanted.alias("k"))
    last = running.where(F.col("upto") >= F.col("k")).agg(
        F.min(F.struct("b", (F.col("k") - (F.col("upto") - F.col("c"))).alias("left"))).alias("e")
    ).scalar()
    edge = df.where(bucket == last["b"]).select(F.struct(hexed.alias("h"), col(key).alias("k")).alias("s"))
    placed = edge.select("s", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("s")).alias("place"))
    cut = placed.where(F.col("place") == last["left"]).agg(F.max("s").alias("s")).scalar()
    return df.withColumn("is_test", F.struct(hexed.alias("h"), col(key).alias("k")) <= cut)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) with a test share of exactly ceil(n·test_size), by hash of the unique key.

    With ``keep`` the rows are written with their side, so that fits and scores that read them again hash no keys.
    """
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must lie in 0.1..0.5")
    flagged = with_test_flag(df, key, test_size, seed)
    flagged = settle(flagged) if keep else flagged
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def standard_scale(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables scaled by mean and population standard deviation of the training rows."""
    facts = scalar_row(
        train,
        **{f"m{i}": F.avg(col(c)) for i, c in enumerate(cols)},
        **{f"s{i}": F.stddev_pop(col(c)) for i, c in enumerate(cols)},
    )

    def scaled(df: DataFrame) -> DataFrame:
        place = {c: i for i, c in enumerate(cols)}

        def one(c: str) -> Column:
            centred = col(c) - facts[f"m{place[c]}"]
            # A constant column is centred only.
            return (centred / F.when(facts[f"s{place[c]}"] == 0, 1.0).otherwise(facts[f"s{place[c]}"])).alias(c)

        return df.select(*[one(c) if c in place else col(c) for c in df.columns])

    return scaled(train), scaled(test)


def binarize_by_median(df: DataFrame, name: str, label: str = "label") -> DataFrame:
    """Add ``label`` = 1 where the value lies above the median; an error if one class is empty."""
    numbers = df.select(F.when(present(df, name), col(name).cast("double")).alias("y"))
    median = exact_quantiles(numbers, ["y"], [0.5])["y"][0]
    above, rest = numbers.agg(F.count_if(F.col("y") > median), F.count_if(F.col("y") <= median)).first()
    if not above or not rest:
        raise ValueError(f"the median of {name} leaves one class only")
    return df.withColumn(label, (col(name) > median).cast("double"))


def recommend_model(df: DataFrame, features: list[str], target: str, problem: str) -> DataFrame:
    """(topic, advice): rules over the number of rows and features and the mean absolute correlation."""
    correlations = [F.abs(safe_corr(col(c).cast("double"), col(target).cast("double"))) for c in features[:5]]
    known = F.array_compact(F.array(*correlations))
    facts = df.agg(F.count(F.lit(1)).alias("n"), known.alias("r")).select(
        "n", F.aggregate("r", F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size("r"))).alias("strength")
    )
    n, strength = F.col("n"), F.col("strength")
    if problem == "Classification":
        size = (
            F.when(n < 100, "Small dataset: Logistic Regression, SVM, KNN")
            .when(n < 1000, "Medium dataset: Random Forest, Gradient Boosting, SVM")
            .otherwise("Large dataset: Neural Networks, Gradient Boosting")
        )
        return facts.select(F.lit("size").alias("topic"), size.alias("advice"))
    size = (
        F.when(n < 100, "Small dataset: Linear, Ridge, Lasso")
        .when(n < 1000, "Medium dataset: Random Forest, Gradient Boosting")
        .otherwise("Large dataset: any model, Gradient Boosting and Random Forest excel")
    )
    linearity = (
        F.when(strength > 0.7, "Strong linear relationship: Linear Regression")
        .when(strength > 0.3, "Moderate relationship: Random Forest, Gradient Boosting")
        .otherwise("Weak linear relationship: SVM, Neural Network")
    )
    rows = [F.struct(F.lit("size").alias("topic"), size.alias("advice"))]
    if len(features) > 50:
        rows.append(F.struct(F.lit("features").alias("topic"), F.lit("Many features: select or reduce them").alias("advice")))
    rows.append(F.struct(F.lit("linearity").alias("topic"), linearity.alias("advice")))
    return facts.select(F.inline(F.array(*rows)))


def polynomial_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``c_squared`` and ``c_cubed``."""
    powers = []
    for c in cols:
        powers += [(col(c) * col(c)).alias(f"{c}_squared"), (col(c) * col(c) * col(c)).alias(f"{c}_cubed")]
    return df.select("*", *powers)


def interaction_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``a_x_b`` for each pair of columns."""
    return df.select("*", *[(col(a) * col(b)).alias(f"{a}_x_{b}") for a, b in combinations(cols, 2)])


def weak_features(df: DataFrame, cols: list[str], target: str, threshold: float = 0.1) -> list[str]:
    """Columns whose absolute correlation with the target is below the threshold."""
    y = col(target).cast("double")
    row = df.agg(*[F.abs(safe_corr(col(c).cast("double"), y)) for c in cols]).first()
    return [c for c, r in zip(cols, row) if r is not None and r < threshold]


def drop_weak_features(df: DataFrame, cols: list[str], target: str, threshold: float = 0.1) -> DataFrame:
    """Drop weak columns; one with an undefined correlation stays."""
    return df.drop(*weak_features(df, cols, target, threshold))


def _z_scores(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Mean-filled z-scores with the population standard deviation; null for a constant column."""
    value = {c: F.when(present(df, c), col(c).cast("double")) for c in cols}
    facts = scalar_row(
        df,
        **{f"m{i}": F.avg(value[c]) for i, c in enumerate(cols)},
        # Filled cells add no deviation but count in n.
        **{f"s{i}": F.stddev_pop(value[c]) * F.sqrt(F.count(value[c]) / F.count(F.lit(1))) for i, c in enumerate(cols)},
    )
    return {
        c: F.when(facts[f"s{i}"] > 0, F.coalesce((value[c] - facts[f"m{i}"]) / facts[f"s{i}"], F.lit(0.0)))
        for i, c in enumerate(cols)
    }


def outlier_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, outliers, pct) of the columns with values beyond three standard deviations."""
    cols = cols or numeric_columns(df)
    z = _z_scores(df, cols)
    flagged = df.select(*[(F.abs(z[c]) > OUTLIER_Z).alias(f"f{i}") for i, c in enumerate(cols)])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(f"f{i}")).alias("outliers"),
            F.round(F.count_if(F.col(f"f{i}")) / F.count(F.lit(1)) * 100, 2).alias("pct"),
        )
        for i, c in enumerate(cols)
    ]
    return flagged.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("outliers > 0")


def remove_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with every z-score below three in size; constant columns do not count."""
    cols = cols or numeric_columns(df)
    z = _z_scores(df, cols)
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.abs(z[c]) < OUTLIER_Z, F.lit(True)) for c in cols]))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, features and target together."""
    return df.dropDuplicates()


def quality_metrics(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: duplicates, missing, features, samples."""
    inputs = df.select(*[col(c) for c in features])
    return inputs.agg(F.count(F.lit(1)).alias("samples")).select(
        duplicate_count(inputs).scalar().alias("duplicates"),
        missing_totals(inputs).select("all_missing").scalar().alias("missing"),
        F.lit(len(features)).cast("bigint").alias("features"),
        "samples",
    )


def _resample(df: DataFrame, key: str, by: list[str], multiplier: int, seed: int) -> DataFrame:
    """The original rows (copy 0) and ``multiplier - 1`` draws of n with replacement, per group."""
    if not 1 <= multiplier <= 5:
        raise ValueError("multiplier must lie in 1..5")
    original = df.withColumn("copy", F.lit(0)).withColumn("draw", F.lit(0))
    if multiplier == 1:
        return original
    # Drawn from and drawn by: both sides of the join below.
    numbered = settle(number_rows(df, key, by, seed))
    draws = numbered.select(
        *[col(b).alias(f"_by{i}") for i, b in enumerate(by)],
        col(key).alias("_drawer"),
        "_rows",
        F.explode(F.sequence(F.lit(1), F.lit(multiplier - 1))).alias("copy"),
    )
    u = hash_uniform(F.concat_ws("#", col("_drawer").cast("string"), F.col("copy").cast("string")), seed)
    # Only the drawn row number travels. Draws of the same row are counted before the join.
    counted = draws.groupBy(*[f"_by{i}" for i in range(len(by))], F.floor(u * F.col("_rows")).alias("_pick"), "copy").agg(
        F.count(F.lit(1)).alias("_times")
    )
    condition = F.col("_pick") == F.col("_row")
    for i, b in enumerate(by):
        condition = condition & F.col(f"_by{i}").eqNullSafe(col(b))
    drawn = numbered.join(counted, condition).select(
        *[col(c) for c in df.columns], "copy", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).alias("draw")
    )
    return original.unionByName(drawn)


def bootstrap_augment(df: DataFrame, key: str, multiplier: int = 2, seed: int = 42) -> DataFrame:
    """The table and ``multiplier - 1`` bootstrap resamples.

    ``copy`` numbers the resamples from 1 (0 is the original), ``draw`` the repeats of a row in one.
    """
    return _resample(df, key, [], multiplier, seed)


def stratified_augment(df: DataFrame, key: str, strata: str, multiplier: int = 2, seed: int = 42) -> DataFrame:
    """Resamples within each stratum, so that the shares stay exactly equal."""
    return _resample(df, key, [strata], multiplier, seed)


def augment_summary(original: DataFrame, augmented: DataFrame) -> DataFrame:
    """One row: original_size, new_size, factor."""
    n = scalar_row(original, n=F.count(F.lit(1)))["n"]
    return augmented.agg(F.count(F.lit(1)).alias("new_size")).select(
        n.alias("original_size"), "new_size", F.try_divide(F.col("new_size"), n).alias("factor")
    )
