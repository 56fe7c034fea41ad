"""Training on whole gradients: independence of the partitioning, optima, kernel features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import models, networks


def table(spark, n, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    x[:hot] = 0.5
    y = np.sin(2 * x[:, 0]) * 10 + x[:, 1] ** 2 + 100
    return models.assemble(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double"), ["a", "b"])


def test_weights_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(networks, "CELLS", 16)  # many blocks
    monkeypatch.setattr(networks, "BLOCKS", 1)
    monkeypatch.setattr(networks, "UNITS", 66)  # several blocks a unit, and a tree of two levels
    df = table(spark, 1500, hot=500).persist()
    fits = [networks.fit_network(df.repartition(parts), "features", "label", [8, 4], max_iter=6).weights for parts in (2, 8, 64)]
    assert all(np.abs(f - fits[0]).max() < 1e-9 for f in fits[1:])


def test_sums_are_those_of_one_pass(spark, monkeypatch):
    monkeypatch.setattr(networks, "CELLS", 50)
    df = table(spark, 500, hot=200)
    rows = df.select(F.array("a", "b").alias("x"), F.col("label").alias("y"))
    local = rows.toPandas()
    x, y = np.stack(local.x.to_numpy()), local.y.to_numpy()
    shapes = networks._shapes(2, [5])
    flat = np.random.default_rng(3).normal(0, 1, 2 * 5 + 5 + 5 + 1)
    objective = networks.Objective(rows, 2, shapes, 0.1, None, None)
    loss, slope = objective(flat)
    objective.close()

    def whole(w):
        layers = networks._unpack(w, shapes)
        return float(((networks._forward(x, layers)[-1][:, 0] - y) ** 2).mean() / 2 + 0.05 * sum((a**2).sum() for a, _ in layers))

    assert loss == pytest.approx(whole(flat), rel=1e-12)
    bumps = [(whole(flat + 1e-6 * e) - whole(flat - 1e-6 * e)) / 2e-6 for e in np.eye(len(flat))]
    assert slope == pytest.approx(bumps, rel=1e-4, abs=1e-6)


def test_support_vector_regression_reaches_its_optimum(spark):
    """No random change of the weights lowers the exact loss, and the fit says that it ended by itself."""
    df = table(spark, 400)
    model = models.train_svr(df, cost=10.0, epsilon=0.5, kernel="linear")
    assert model.report.converged
    local = df.toPandas()
    x, y = local[["a", "b"]].to_numpy(), local.label.to_numpy()

    def exact(w):
        error = np.abs(x @ w[:2] + w[2] - (y - model.mean) / model.scale) - 0.5 / model.scale
        return np.maximum(error, 0).mean() + model.scale / (10.0 * len(y)) * (w[:2] ** 2).sum() / 2

    rng = np.random.default_rng(2)
    here = exact(model.weights)
    assert all(exact(model.weights + rng.normal(0, size, 3)) > here - 5e-3 for size in (0.5, 0.05, 0.005) for _ in range(200))


def test_landmarks_meet_the_error_asked_for(spark):
    df = table(spark, 3000)
    found = networks.find_landmarks(df, "features", 0.5, error=0.01)
    rough = networks.find_landmarks(df, "features", 0.5, error=0.3)
    assert found.error <= 0.01 < 1 and len(rough.points) < len(found.points)
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, (2, 200, 2))
    exact = np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.abs(found.features(a) @ found.features(b).T - exact).mean() < 0.01
    assert np.array_equal(found.points, networks.find_landmarks(df.repartition(7), "features", 0.5).points)


def test_report_falls(spark):
    model = networks.fit_network(table(spark, 300), "features", "label", [6], max_iter=20)
    rows = model.convergence(table(spark, 1)).orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, model.rounds + 1))
    losses = [r.loss for r in rows]
    assert losses == sorted(losses, reverse=True)


def test_one_row_and_constant_labels(spark):
    df = table(spark, 1)
    assert networks.fit_network(df, "features", "label", [3], max_iter=5).transform(df).first().prediction == pytest.approx(df.first().label, abs=1e-3)
    flat = table(spark, 50).withColumn("label", F.lit(7.0))
    assert models.train_svr(flat).transform(flat).agg(F.max(F.abs(F.col("prediction") - 7))).first()[0] < 0.2
