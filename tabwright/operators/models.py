"""Models: train, predict, evaluate, compare, tune, combine.

A trainer takes ``(df, features_col, label_col, prediction_col, **params)`` and returns a model with
``transform``. Penalties are converted so that Spark minimises the usual objectives:
ridge |y-Xw|² + α|w|², lasso and elastic net |y-Xw|²/2n + α(r|w|₁ + (1-r)|w|²/2), logistic and SVM C·loss + |w|²/2.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_uniform
from ..plans.ranks import number_rows
from ..plans.scalars import col, shared
from ..session import settle
from .forests import train_deep_forest, train_mean_forest
from .lsh_neighbors import lsh_classifier
from .neighbors import knn_classifier
from .moments import Moments, moments_by
from .networks import find_landmarks, fit_network
from .impute import impute_features_mean
from .prep import (
    binarize_by_median, bootstrap_augment, drop_duplicate_rows, interaction_features, polynomial_features, prepare_xy, remove_outliers,
    train_test_split, weak_features,
)

SEED = 42
KERNELS = ("rbf", "linear", "poly")
WEIGHT = "_weight"


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def _columns(features_col: str, label_col: str, prediction_col: str) -> dict[str, str]:
    return {"featuresCol": features_col, "labelCol": label_col, "predictionCol": prediction_col}


def _linear(df, features_col, label_col, prediction_col, l1: float, l2: float):
    """Least squares with penalty l1·|w|₁ + l2·|w|²/2 per row; one pass over the data.

    The solver scales the L2 part by the population standard deviation of the label.
    """
    scale = 1.0
    if l2:
        scale = df.agg(F.stddev_pop(col(label_col))).first()[0] or 1.0
    total = l1 + l2 * scale
    return LinearRegression(
        **_columns(features_col, label_col, prediction_col), solver="normal", standardization=False,
        regParam=total, elasticNetParam=l1 / total if total else 0.0, maxIter=1000, tol=1e-12,
    ).fit(df)


def train_linear_regression(df, features_col="features", label_col="label", prediction_col="prediction"):
    return _linear(df, features_col, label_col, prediction_col, 0.0, 0.0)


def train_ridge(df, features_col="features", label_col="label", prediction_col="prediction", alpha: float = 1.0):
    return _linear(df, features_col, label_col, prediction_col, 0.0, alpha / max(df.count(), 1))


def train_lasso(df, features_col="features", label_col="label", prediction_col="prediction", alpha: float = 0.1):
    return _linear(df, features_col, label_col, prediction_col, alpha, 0.0)


def train_elastic_net(
    df, features_col="features", label_col="label", prediction_col="prediction", alpha: float = 0.1, l1_ratio: float = 0.5
):
    return _linear(df, features_col, label_col, prediction_col, alpha * l1_ratio, alpha * (1 - l1_ratio))


def train_random_forest_regressor(
    df, features_col="features", label_col="label", prediction_col="prediction", trees: int = 100, depth: int = 10, min_leaf: int = 1
):
    found = train_mean_forest(df, features_col, label_col, prediction_col, trees, depth, min_leaf, SEED)
    # Inputs of too many distinct values, or trees too deep, for one task a tree.
    return found or RandomForestRegressor(
        **_columns(features_col, label_col, prediction_col), numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all", maxMemoryInMB=1024, seed=SEED,
    ).fit(df)


#: Counted rows that a task should hold, so that the many short jobs of a fit stay short.
COUNTED_PER_TASK = 10_000


@contextmanager
def _counted(df: DataFrame, features_col: str, label_col: str, means: bool = False) -> Iterator[DataFrame]:
    """Equal rows once, ``WEIGHT`` telling how many they are: a weighted sum over them is the sum over all rows.

    With ``means`` equal inputs are one row with their mean label. Splits by squared error stay the same, as the error within equal
    inputs is part of every split alike.
    """
    given = df.select(vector_to_array(col(features_col)).alias("_x"), col(label_col).cast("double").alias("_y")).where("_y is not null")
    n = F.count(F.lit(1)).cast("double").alias(WEIGHT)
    counted = given.groupBy("_x").agg(F.avg("_y").alias("_y"), n) if means else given.groupBy("_x", "_y").agg(n)
    rows = counted.select(array_to_vector("_x").alias(features_col), F.col("_y").alias(label_col), WEIGHT)
    with shared(rows, COUNTED_PER_TASK) as kept:
        yield kept


def _number(counted: DataFrame) -> float:
    """The number of rows that counted rows stand for."""
    return counted.agg(F.sum(WEIGHT)).first()[0] or 1.0


def train_gbt_regressor(
    df, features_col="features", label_col="label", prediction_col="prediction", rounds: int = 100, depth: int = 5, rate: float = 0.1
):
    with _counted(df, features_col, label_col, means=True) as rows:
        return GBTRegressor(
            **_columns(features_col, label_col, prediction_col), weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED,
        ).fit(rows)


class Chain:
    """A feature step followed by a fitted model."""

    def __init__(self, step: Callable[[DataFrame], DataFrame], model: Any, made: str):
        self.step, self.model, self.made = step, model, made

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.step(df)).drop(self.made)


def _check_kernel(kernel: str) -> None:
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}; choose one of {', '.join(KERNELS)}")


def rbf_gamma(df: DataFrame, features_col: str) -> tuple[int, float]:
    """Number of inputs and the kernel's width 1 / (inputs x variance of all input values); one pass."""
    x = col(features_col)
    mean, var, n = df.agg(Summarizer.mean(x), Summarizer.variance(x), Summarizer.count(x)).first()
    mean, var = np.array(mean), np.array(var) * (n - 1) / max(n, 1)
    spread = float(np.mean(var + mean**2) - np.mean(mean) ** 2)
    return len(mean), 1.0 / (len(mean) * spread) if spread > 0 else 1.0 / len(mean)


def _expansion(df: DataFrame, features_col: str, made: str, degree: int) -> Callable[[DataFrame], DataFrame]:
    """All products of up to ``degree`` inputs, each brought to unit variance."""
    raw = f"{made}_raw"
    products = PolynomialExpansion(inputCol=features_col, outputCol=raw, degree=degree)
    scaler = StandardScaler(inputCol=raw, outputCol=made, withMean=True).fit(products.transform(df))
    return lambda d: scaler.transform(products.transform(d)).drop(raw)


def train_svr(
    df, features_col="features", label_col="label", prediction_col="prediction", cost: float = 100.0, epsilon: float = 0.1,
    kernel: str = "rbf", landmarks: int = 1024, degree: int = 3, max_iter: int | None = None,
):
    """Support vector regression on scaled features, iterated until it gains no more.

    ``rbf`` uses Nyström features of up to ``landmarks`` rows, ``poly`` the explicit expansion, ``linear`` the inputs.
    """
    _check_kernel(kernel)
    found, step, inputs_col, made = None, None, features_col, f"_kernel_{prediction_col}"
    if kernel == "rbf":
        found = find_landmarks(df, features_col, rbf_gamma(df, features_col)[1], most=landmarks)
    elif kernel == "poly":
        step, inputs_col = _expansion(df, features_col, made, degree), made
    model = fit_network(
        step(df) if step else df, inputs_col, label_col, [], max_iter=max_iter, epsilon=epsilon, cost=cost, kernel=found,
        prediction_col=prediction_col,
    )
    return Chain(step, model, made) if step else model


def train_mlp_regressor(
    df, features_col="features", label_col="label", prediction_col="prediction", hidden: tuple = (100, 50), max_iter: int = 500
):
    return fit_network(df, features_col, label_col, list(hidden), max_iter=max_iter, prediction_col=prediction_col)


def train_logistic_regression(
    df, features_col="features", label_col="label", prediction_col="prediction", cost: float = 1.0, max_iter: int = 1000
):
    with _counted(df, features_col, label_col) as rows:
        return LogisticRegression(
            **_columns(features_col, label_col, prediction_col), **_scores(prediction_col), weightCol=WEIGHT, regParam=1.0 / (cost * _number(rows)),
            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9,
        ).fit(rows)


def train_random_forest_classifier(
    df, features_col="features", label_col="label", prediction_col="prediction", trees: int = 100, depth: int | None = None, min_leaf: int = 1
):
    """Without ``depth`` trees grow until their leaves are pure."""
    if depth is None:
        return train_deep_forest(df, features_col, label_col, prediction_col, trees, min_leaf, SEED)
    return RandomForestClassifier(
        **_columns(features_col, label_col, prediction_col), **_scores(prediction_col), numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", maxMemoryInMB=1024, seed=SEED,
    ).fit(df)


def train_gbt_classifier(
    df, features_col="features", label_col="label", prediction_col="prediction", rounds: int = 100, depth: int = 3, rate: float = 0.1
):
    trees = GBTClassifier(
        **_columns(features_col, label_col, prediction_col), weightCol=WEIGHT, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED,
    )
    names = _scores(prediction_col)
    with _counted(df, features_col, label_col) as rows:
        return trees.setProbabilityCol(names["probabilityCol"]).setRawPredictionCol(names["rawPredictionCol"]).fit(rows)


def train_naive_bayes(df, features_col="features", label_col="label", prediction_col="prediction"):
    return NaiveBayes(
        **_columns(features_col, label_col, prediction_col), **_scores(prediction_col), modelType="gaussian",
    ).fit(df)


def train_svm_classifier(
    df, features_col="features", label_col="label", prediction_col="prediction", cost: float = 100.0, kernel: str = "rbf",
    landmarks: int = 1024, degree: int = 3, max_iter: int = 10_000, tol: float = 1e-3,
):
    """Support vector classification on scaled features, iterated to the tolerance ``tol``.

    ``rbf`` uses Nyström features of up to ``landmarks`` rows, ``poly`` the explicit expansion, ``linear`` the inputs.
    """
    _check_kernel(kernel)
    made = f"_kernel_{prediction_col}"
    if kernel == "rbf":
        found = find_landmarks(df, features_col, rbf_gamma(df, features_col)[1], most=landmarks)

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(found.features(np.stack(x.to_numpy()))))

        def step(d: DataFrame) -> DataFrame:
            return d.withColumn(made, array_to_vector(mapped(vector_to_array(col(features_col)))))
    elif kernel == "poly":
        step = _expansion(df, features_col, made, degree)
    else:

        def step(d: DataFrame) -> DataFrame:
            return d.withColumn(made, col(features_col))

    with _counted(df, features_col, label_col) as rows:
        # The features are made once, not in every iteration.
        with shared(step(rows).select(made, label_col, WEIGHT)) as inputs:
            model = LinearSVC(
                featuresCol=made, labelCol=label_col, predictionCol=prediction_col, rawPredictionCol=f"{prediction_col}_raw", weightCol=WEIGHT,
                regParam=1.0 / (cost * _number(rows)), standardization=False, maxIter=max_iter, tol=tol,
            ).fit(inputs)
    return Chain(step, model, made)


class NearestModel:
    """The training rows, and a vote of the nearest of them for each row."""

    def __init__(
        self, train: DataFrame, features_col: str, label_col: str, prediction_col: str, key: str, neighbors: int, recall: float | None = None
    ):
        self.recall = recall
        self.features_col, self.label_col, self.prediction_col, self.key, self.neighbors = features_col, label_col, prediction_col, key, neighbors
        self.inputs = [f"_{prediction_col}_{i}" for i in range(len(train.select(features_col).first()[0]))]
        self.train = self._spread(train).select(key, label_col, *self.inputs)

    def _spread(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(col(self.features_col))
        return df.withColumns({c: x[i] for i, c in enumerate(self.inputs)})

    def transform(self, df: DataFrame) -> DataFrame:
        given = self.train, self._spread(df), self.inputs, self.label_col, self.key, self.neighbors, self.prediction_col
        found = knn_classifier(*given) if self.recall is None else lsh_classifier(*given, self.recall)
        return found.drop(*self.inputs)


def train_knn(
    df, features_col="features", label_col="label", prediction_col="prediction", key: str | None = None, neighbors: int = 5,
    recall: float | None = None,
):
    """``key`` names a column that is unique in training and test rows. With ``recall`` the neighbours are approximate."""
    if key is None:
        raise ValueError("KNN needs the name of a unique key column")
    return NearestModel(df, features_col, label_col, prediction_col, key, neighbors, recall)


def _scores(prediction_col: str) -> dict[str, str]:
    return {"probabilityCol": f"{prediction_col}_probability", "rawPredictionCol": f"{prediction_col}_raw"}


REGRESSORS: dict[str, Callable] = {
    "Linear Regression": train_linear_regression,
    "Ridge Regression": train_ridge,
    "Lasso Regression": train_lasso,
    "Elastic Net": train_elastic_net,
    "Random Forest": train_random_forest_regressor,
    "Gradient Boosting": train_gbt_regressor,
    "SVR (SVM)": train_svr,
    "Neural Network": train_mlp_regressor,
}
CLASSIFIERS: dict[str, Callable] = {
    "Logistic Regression": train_logistic_regression,
    "Random Forest": train_random_forest_classifier,
    "Gradient Boosting": train_gbt_classifier,
    "SVM": train_svm_classifier,
    "KNN": train_knn,
    "Naive Bayes": train_naive_bayes,
}
NEEDS_SCALING = {"SVR (SVM)", "Neural Network", "SVM"}
# The ranges within which the models may be tuned.
TUNING_RANGES = {
    "Ridge Regression": {"alpha": (0.001, 10.0)},
    "Lasso Regression": {"alpha": (0.001, 1.0)},
    "Elastic Net": {"alpha": (0.001, 1.0), "l1_ratio": (0.0, 1.0)},
    "Random Forest": {"trees": (10, 300), "depth": (3, 20), "min_leaf": (1, 20)},
    "Gradient Boosting": {"rounds": (10, 300), "rate": (0.001, 0.3), "depth": (1, 10)},
    "Logistic Regression": {"cost": (0.001, 100.0)},
    "SVR (SVM)": {"cost": (0.1, 1000.0)},
    "SVM": {"cost": (0.1, 1000.0)},
    "KNN": {"neighbors": (1, 20)},
    "Neural Network": {"max_iter": (100, 2000)},
}
# The neurons in each hidden layer that may be chosen.
LAYER_RANGES = ((10, 200), (10, 100))


def _regression_struct(label: Column, prediction: Column) -> Column:
    error = label - prediction
    known = label.isNotNull() & prediction.isNotNull()
    return F.struct(
        (1 - F.try_divide(F.sum(error * error), F.var_pop(F.when(known, label)) * F.count(F.when(known, label)))).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def _classification_struct(label: Column, prediction: Column) -> Column:
    hit = F.count_if((label == 1) & (prediction == 1))
    precision = F.coalesce(F.try_divide(hit, F.count_if(prediction == 1)), F.lit(0.0))
    recall = F.coalesce(F.try_divide(hit, F.count_if(label == 1)), F.lit(0.0))
    return F.struct(
        F.try_divide(F.count_if(label == prediction), F.count(F.lit(1))).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )


def regression_metrics(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """One row: r2, rmse, mae."""
    return df.agg(_regression_struct(col(label_col), col(prediction_col)).alias("m")).select("m.*")


def classification_metrics(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall, f1 of class 1; 0 where a ratio is undefined."""
    return df.agg(_classification_struct(col(label_col), col(prediction_col)).alias("m")).select("m.*")


def score_models(test: DataFrame, models: dict[str, Any], problem: str, label_col: str = "label") -> DataFrame:
    """(position, model, metrics…): all models applied and measured in one pass over the test rows.

    ``models`` maps a name to (model, prediction column).
    """
    applied = test
    for model, _ in models.values():
        applied = model.transform(applied)
    measure = _regression_struct if problem == "Regression" else _classification_struct
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("model"), measure(col(label_col), col(p)).alias("m"))
        for i, (name, (_, p)) in enumerate(models.items())
    ]
    return applied.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).select("position", "model", "m.*")


def train_models(train: DataFrame, names: list[str], problem: str, params: dict[str, dict] | None = None, label_col: str = "label") -> dict[str, Any]:
    """Fit the named models; name to (model, prediction column)."""
    trainers = REGRESSORS if problem == "Regression" else CLASSIFIERS
    fitted = {}
    for i, name in enumerate(names):
        options = {"label_col": label_col, "prediction_col": f"p{i}", **(params or {}).get(name, {})}
        if name not in NEEDS_SCALING:
            fitted[name] = trainers[name](train, features_col="features", **options), f"p{i}"
        elif "scaled" in train.columns:
            fitted[name] = trainers[name](train, features_col="scaled", **options), f"p{i}"
        else:
            # The scale belongs to the model: it comes from the rows that it is trained on, in each fold anew.
            made = f"_scaled_p{i}"
            scaler = StandardScaler(inputCol="features", outputCol=made, withMean=True).fit(train)
            fitted[name] = Chain(scaler.transform, trainers[name](scaler.transform(train), features_col=made, **options), made), f"p{i}"
    return fitted


def compare_models(train: DataFrame, test: DataFrame, names: list[str], problem: str = "Regression", params: dict[str, dict] | None = None) -> DataFrame:
    """One row per model with its test metrics."""
    with shared(train) as rows:
        fitted = train_models(rows, names, problem, params)
    return score_models(test, fitted, problem)


def prepare_and_compare(
    df: DataFrame, target: str, features: list[str], key: str, order_by: list[str] | None = None, names: list[str] | None = None,
    problem: str = "Regression", test_size: float = 0.2, params: dict[str, dict] | None = None,
) -> DataFrame:
    """From a raw table to graded models: coded target, numeric inputs, mean fill, split, fit, test metrics, grade.

    ``key`` is unique; ``order_by`` (the key by default) settles the codes of a text target. A row without a label takes no part.
    For classes the label is split at its median.
    """
    prepared = prepare_xy(df.where(col(target).isNotNull()), target, features, order_by or [key])
    rows = impute_features_mean(prepared.df, prepared.features)
    if problem == "Classification":
        rows = binarize_by_median(rows.withColumnRenamed("label", "_value"), "_value")
    train, test = (assemble(d, prepared.features) for d in train_test_split(rows, key, test_size))
    every = names or list(REGRESSORS if problem == "Regression" else CLASSIFIERS)
    scores = compare_models(train, test, every, problem, {"KNN": {"key": key}} | (params or {}))
    return scores.withColumn("grade", grade_performance(F.col("r2" if problem == "Regression" else "accuracy"), problem))


def best_model(comparison: DataFrame, metric: str) -> DataFrame:
    """The row with the largest metric, the first listed of several."""
    return comparison.orderBy(F.desc(metric), "position").limit(1)


def improvement_pct(new: Column, old: Column) -> Column:
    """(new - old) / |old| · 100; null if the old value is 0."""
    return F.try_divide(new - old, F.abs(old)) * 100


def check_params(name: str, params: dict[str, Any]) -> None:
    for key, (low, high) in TUNING_RANGES.get(name, {}).items():
        if key in params and params[key] is not None and not low <= params[key] <= high:
            raise ValueError(f"{name}: {key} must lie in {low}..{high}")
    if name == "Neural Network" and "hidden" in params:
        layers = params["hidden"]
        if len(layers) != len(LAYER_RANGES) or any(not low <= n <= high for n, (low, high) in zip(layers, LAYER_RANGES, strict=True)):
            raise ValueError(f"{name}: hidden layers must lie in {LAYER_RANGES}")


def tune(train: DataFrame, test: DataFrame, name: str, params: dict[str, Any], problem: str = "Regression") -> DataFrame:
    """(position, model, metrics…, delta): the model refitted with ``params`` and its gain over the default."""
    check_params(name, params)
    with shared(train) as rows:
        default, tuned = train_models(rows, [name], problem), train_models(rows, [name], problem, {name: params})
    metric = "r2" if problem == "Regression" else "accuracy"
    before = score_models(test, default, problem).select(metric).scalar()
    scored = score_models(test, tuned, problem)
    return scored.withColumn("delta", F.col(metric) - before)


def merge_tuned(default: DataFrame, tuned: DataFrame) -> DataFrame:
    """The comparison with tuned rows in place of default ones and a ``status`` column."""
    metrics = [c for c in default.columns if c not in ("position", "model")]
    t = tuned.select(F.col("model").alias("_model"), *[F.col(c).alias(f"_{c}") for c in metrics])
    return default.join(t, F.col("model") == F.col("_model"), "left").select(
        "position", "model",
        F.when(F.col("_model").isNotNull(), "TUNED").otherwise("Default").alias("status"),
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in metrics],
    )


def with_fold(df: DataFrame, key: str, folds: int = 5, label_col: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``fold``: by hash without a shuffle, or dealt out within each class if ``label_col`` is given."""
    if label_col is None:
        return df.withColumn("fold", F.floor(hash_uniform(col(key), seed) * folds).cast("int"))
    return number_rows(df, key, [label_col], seed).withColumn("fold", F.pmod(F.col("_row"), F.lit(folds)).cast("int")).drop("_row", "_rows")


#: The linear regressors: weights of a model from the moments of its training rows.
FROM_MOMENTS: dict[str, Callable[..., np.ndarray]] = {
    "Linear Regression": lambda m: m.ridge(0.0),
    "Ridge Regression": lambda m, alpha=1.0: m.ridge(alpha),
    "Lasso Regression": lambda m, alpha=0.1: m.elastic_net(alpha, 1.0),
    "Elastic Net": lambda m, alpha=0.1, l1_ratio=0.5: m.elastic_net(alpha, l1_ratio),
}


def fold_scores(parts: dict[int, Moments], name: str, folds: int, params: dict | None = None) -> list[tuple[int, float | None]]:
    """(fold, R²) of a linear model, trained on the other folds, from the moments of the folds alone."""
    empty = Moments(0, np.empty(0), np.empty((0, 0)))
    out = []
    for i in range(folds):
        train = reduce(Moments.merge, (m for k, m in sorted(parts.items()) if k != i), empty)
        test = parts.get(i, empty)
        out.append((i, test.r2(FROM_MOMENTS[name](train, **(params or {}))) if train.n and test.n else None))
    return out


def cross_validate(df: DataFrame, key: str, name: str, problem: str = "Regression", folds: int = 5, params: dict | None = None, label_col: str = "label") -> DataFrame:
    """(fold, score): R² or accuracy on each held-out fold; classes keep their shares. Linear regressors take one scan for all folds."""
    if problem == "Regression" and name in FROM_MOMENTS:
        parts = moments_by(with_fold(df, key, folds), "features", label_col, "fold")
        return df.sparkSession.createDataFrame(fold_scores(parts, name, folds, params), "fold int, score double")
    if name == "KNN":
        params = {"key": key} | (params or {})
    metric = "r2" if problem == "Regression" else "accuracy"
    with shared(with_fold(df, key, folds, label_col if problem == "Classification" else None)) as folded:
        parts = []
        for i in range(folds):
            fitted = train_models(folded.where(F.col("fold") != i), [name], problem, {name: params or {}}, label_col)
            scored = score_models(folded.where(F.col("fold") == i), fitted, problem, label_col)
            parts.append(scored.select(F.lit(i).alias("fold"), F.col(metric).alias("score")))
        # One number per fold.
        scores = [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()]
    return df.sparkSession.createDataFrame(scores, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of the fold scores."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def _summary(scores: list[float | None]) -> tuple[float | None, float | None]:
    known = [s for s in scores if s is not None]
    return (float(np.mean(known)), float(np.std(known))) if known else (None, None)


#: Of the settings of a rung one in so many goes on to the next, which trains on so many times the rows.
HALVING = 3


def search(
    df: DataFrame, key: str, name: str, grid: dict[str, list], problem: str = "Regression", folds: int = 5, label_col: str = "label",
    at_once: int = 4, rungs: int | None = None,
) -> DataFrame:
    """(setting, params, rung, mean, std, place): the cross-validated score of every combination of the values in ``grid``.

    All settings share the folds. Linear regressors take one scan for all of them. Other models run by successive halving, ``at_once``
    settings at a time: each rung trains on ``HALVING`` times the rows of the one before, a nested share by hash, and keeps the
    best; the last rung sees all rows. ``rungs=1`` tries every setting on all rows. ``place`` ranks later rungs first, then the score.
    """
    settings = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    for params in settings:
        check_params(name, params)
    found: dict[int, tuple[int, float | None, float | None]] = {}
    if problem == "Regression" and name in FROM_MOMENTS:
        parts = moments_by(with_fold(df, key, folds), "features", label_col, "fold")
        found = {i: (0, *_summary([s for _, s in fold_scores(parts, name, folds, p)])) for i, p in enumerate(settings)}
    else:
        count = rungs or max(1, int(np.floor(np.log(max(len(settings), 1)) / np.log(HALVING))) + 1)
        left = list(range(len(settings)))
        with shared(df) as rows, ThreadPoolExecutor(at_once) as pool:
            for rung in range(count):
                share = float(HALVING) ** (rung + 1 - count)
                some = rows if rung == count - 1 else rows.where(hash_uniform(col(key), SEED + 1) < share)

                def score(i: int, some=some) -> list[float | None]:
                    return [r.score for r in cross_validate(some, key, name, problem, folds, settings[i], label_col).collect()]

                for i, scores in zip(left, pool.map(score, left), strict=True):
                    found[i] = (rung, *_summary(scores))
                ranked = sorted(left, key=lambda i: (found[i][1] is None, -(found[i][1] or 0.0), i))
                left = ranked[: max(1, len(ranked) // HALVING)] if rung < count - 1 else ranked
    order = sorted(found, key=lambda i: (-found[i][0], found[i][1] is None, -(found[i][1] or 0.0), i))
    out = [(i, json.dumps(settings[i]), found[i][0], found[i][1], found[i][2], order.index(i) + 1) for i in sorted(found)]
    return df.sparkSession.createDataFrame(out, "setting int, params string, rung int, mean double, std double, place int")


def search_and_compare(
    train: DataFrame, test: DataFrame, key: str, grids: dict[str, dict[str, list]], problem: str = "Regression", folds: int = 5, names: list[str] | None = None,
) -> DataFrame:
    """(position, model, status, metrics…, params): all models on the test rows, those in ``grids`` with the best setting that
    cross-validation on the training rows finds, the others as they are."""
    every = names or list(grids)
    best = {}
    for name, grid in grids.items():
        # One row for each setting.
        best[name] = json.loads(search(train, key, name, grid, problem, folds).where("place = 1").first().params)
    default = compare_models(train, test, every, problem, {"KNN": {"key": key}})
    tuned = compare_models(train, test, list(grids), problem, {n: ({"key": key} if n == "KNN" else {}) | p for n, p in best.items()})
    chosen = F.create_map(*[F.lit(x) for n in best for x in (n, json.dumps(best[n]))])
    return merge_tuned(default, tuned).withColumn("params", chosen[F.col("model")])


def _ensemble(train: DataFrame, names: list[str], problem: str, params: dict | None) -> dict[str, Any]:
    with shared(train) as rows:
        return train_models(rows, names, problem, params)


def voting_regressor(
    train: DataFrame, test: DataFrame, names=("Random Forest", "Gradient Boosting", "Linear Regression"), params: dict | None = None
) -> DataFrame:
    """``test`` with the mean prediction of the members."""
    members = _ensemble(train, list(names), "Regression", params)
    applied = reduce(lambda d, m: m[0].transform(d), members.values(), test)
    mean = sum([col(p) for _, p in members.values()], F.lit(0.0)) / len(members)
    return applied.withColumn("prediction", mean).drop(*[p for _, p in members.values()])


def soft_voting_classifier(
    train: DataFrame, test: DataFrame, names=("Random Forest", "Gradient Boosting", "Logistic Regression"), params: dict | None = None
) -> DataFrame:
    """``test`` with the class of the largest mean probability."""
    members = _ensemble(train, list(names), "Classification", params)
    applied = reduce(lambda d, m: m[0].transform(d), members.values(), test)
    mean = sum([vector_to_array(col(f"{p}_probability"))[1] for _, p in members.values()], F.lit(0.0)) / len(members)
    made = [c for _, p in members.values() for c in (p, f"{p}_probability", f"{p}_raw")]
    return applied.withColumn("probability", mean).withColumn("prediction", (F.col("probability") > 0.5).cast("double")).drop(*made)


# The members of the stacked model.
STACK_MEMBERS = {"Random Forest": {"trees": 50, "depth": 8}, "Gradient Boosting": {"rounds": 50, "rate": 0.1, "depth": 4}}


def stacking_regressor(
    train: DataFrame, test: DataFrame, key: str | None = None, out_of_fold: bool = False, folds: int = 5, params: dict | None = None
) -> DataFrame:
    """``test`` with the prediction of a linear model over the members' predictions.

    ``out_of_fold=True`` trains the linear model on predictions for held-out rows.
    """
    params = params or STACK_MEMBERS
    names = list(params)

    def meta_inputs(d: DataFrame, fitted: dict[str, Any]) -> DataFrame:
        applied = reduce(lambda x, m: m[0].transform(x), fitted.values(), d)
        return assemble(applied, [p for _, p in fitted.values()], "meta")

    with shared(train) as rows:
        members = train_models(rows, names, "Regression", params)
        inputs = meta_inputs(rows, members).select("meta", "label")
        if out_of_fold:
            folded = with_fold(rows, key, folds)
            parts = []
            for i in range(folds):
                fitted = train_models(folded.where(F.col("fold") != i), names, "Regression", params)
                parts.append(meta_inputs(folded.where(F.col("fold") == i), fitted).select("meta", "label"))
            inputs = reduce(DataFrame.unionByName, parts)
        # The fit and its summary both read them; the members predict once.
        with shared(inputs) as seen:
            model = train_linear_regression(seen, "meta", "label", "prediction")
    return model.transform(meta_inputs(test, members)).drop("meta", *[p for _, p in members.values()])


def retrain_on(
    df: DataFrame, features: list[str], key: str, name: str, variant: str, test_size: float = 0.2, params: dict | None = None,
    problem: str = "Regression", label_col: str = "label", train_only: bool = False,
) -> DataFrame:
    """(original, changed, improvement_pct): the test score before and after a change of the data.

    ``variant``: ``augmented`` (bootstrap), ``engineered`` (powers, products, weak ones dropped) or
    ``cleaned`` (outliers and duplicates removed). Augmentation before the split puts copies of a row on both sides of it;
    ``train_only`` splits first and augments the training rows.
    """
    metric = "r2" if problem == "Regression" else "accuracy"
    chosen = {name: params or {}}

    def score(rows: DataFrame, names: list[str], row_key: str, grow: bool = False) -> DataFrame:
        # Columns that the change made and no model reads are not kept for the fits.
        made = [c for c in rows.columns if c not in df.columns and c not in names]
        train, test = (d.drop(*made) for d in train_test_split(rows, row_key, test_size, keep=True))
        train = bootstrap_augment(train, key, 2) if grow else train
        return compare_models(assemble(train, names), assemble(test, names), [name], problem, chosen).select(metric)

    changed, names, row_key = df, list(features), key
    if variant == "augmented" and train_only:
        pass  # the rows stay; those drawn for training are repeated after the split
    elif variant == "augmented":
        changed = bootstrap_augment(df, key, 2)
        # A drawn row gets a key of its own. The split looks at the rows several times; they are drawn once.
        changed = settle(changed.withColumn("_copy_key", F.concat_ws("#", *[c.cast("string") for c in (col(key), F.col("copy"), F.col("draw"))])))
        row_key = "_copy_key"
    elif variant == "engineered":
        changed = interaction_features(polynomial_features(df, features), features)
        names = [c for c in changed.columns if c not in df.columns or c in features]
        weak = weak_features(changed, names, label_col)
        names = [c for c in names if c not in weak]
    elif variant == "cleaned":
        changed = drop_duplicate_rows(remove_outliers(df, features))
    else:
        raise ValueError(f"unknown variant {variant}")
    before = score(df, list(features), key).scalar()
    after = score(changed, names, row_key, variant == "augmented" and train_only).select(F.col(metric).alias("changed"))
    return after.select(
        F.lit(variant).alias("variant"), before.alias("original"), "changed",
        improvement_pct(F.col("changed"), before).alias("improvement_pct"),
    )


def grade_performance(score: Column, problem: str) -> Column:
    """``excellent``, ``good`` or ``poor``."""
    top, fair = (0.9, 0.7) if problem == "Regression" else (0.95, 0.85)
    return F.when(score > top, "excellent").when(score > fair, "good").otherwise("poor")
