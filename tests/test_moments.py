"""Moments of groups in one scan, and the linear models and searches that follow from them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import models
from tabwright.operators.moments import Moments, moments_by


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal([100, 3, 0], [1, 5, 0.1], (900, 3))
    y = x @ [2.0, -1.0, 30.0] + rng.normal(0, 2, 900)
    data = [(i, i % 4, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, fold int, a double, b double, c double, label double").repartition(7)
    return models.assemble(df, ["a", "b", "c"]).persist()


def local(df):
    t = df.toPandas()
    return t[["a", "b", "c", "label"]].to_numpy(), t.fold.to_numpy()


def test_moments_equal_those_of_one_matrix(rows):
    z, fold = local(rows)
    got = moments_by(rows, "features", "label", "fold")
    assert sorted(got) == [0, 1, 2, 3]
    for k, m in got.items():
        own = z[fold == k]
        assert m.n == len(own) and m.mean == pytest.approx(own.mean(axis=0), rel=1e-12)
        assert m.cross == pytest.approx(np.cov(own.T, bias=True) * len(own), rel=1e-7, abs=1e-6)


@pytest.mark.parametrize(("name", "params"), [("Linear Regression", {}), ("Ridge Regression", {"alpha": 7.0}), ("Lasso Regression", {"alpha": 0.3}), ("Elastic Net", {"alpha": 0.5, "l1_ratio": 0.3})])
def test_models_from_moments_equal_fitted_ones(rows, name, params):
    z, _ = local(rows)
    w = models.FROM_MOMENTS[name](Moments.of(z), **params)
    fitted = models.REGRESSORS[name](rows, **params)
    assert w[:3] == pytest.approx(list(fitted.coefficients), rel=1e-3, abs=1e-5)
    x, y = z[:, :3], z[:, 3]
    error = y - x @ w[:3] - w[3]
    # Optimum of the stated objective: no weight's slope leaves what its penalty allows.
    slope = x.T @ error - x.mean(axis=0) * error.sum()
    if name == "Elastic Net" or name == "Lasso Regression":
        a, r = params["alpha"], params.get("l1_ratio", 1.0)
        rest = slope / len(y) - a * (1 - r) * w[:3]
        assert all(abs(g - a * r * np.sign(v)) < 1e-6 if v else abs(g) <= a * r + 1e-6 for g, v in zip(rest, w[:3], strict=True))
    else:
        assert slope == pytest.approx(params.get("alpha", 0.0) * w[:3], abs=1e-3)
    assert Moments.of(z).r2(w) == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_folds_agree_with_single_fits(rows):
    folded = models.with_fold(rows.drop("fold"), "id")
    expected = []
    for i in range(5):
        model = models.train_ridge(folded.where(F.col("fold") != i), alpha=3.0)
        expected.append(models.regression_metrics(model.transform(folded.where(F.col("fold") == i))).first().r2)
    got = models.cross_validate(rows.drop("fold"), "id", "Ridge Regression", params={"alpha": 3.0}).orderBy("fold").collect()
    assert [r.score for r in got] == pytest.approx(expected, abs=1e-6)


def test_search_ranks_every_linear_setting(rows):
    found = models.search(rows.drop("fold"), "id", "Elastic Net", {"alpha": [0.01, 0.5, 1.0], "l1_ratio": [0.0, 1.0]}).collect()
    assert len(found) == 6 and sorted(r.place for r in found) == list(range(1, 7))
    for r in found:
        scores = [x.score for x in models.cross_validate(rows.drop("fold"), "id", "Elastic Net", params=json.loads(r.params)).collect()]
        assert r.mean == pytest.approx(np.mean(scores)) and r.std == pytest.approx(np.std(scores))
    assert max(found, key=lambda r: r.mean).place == 1


def test_halving_keeps_the_best_of_each_rung(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-3, 3, 600)
    df = models.assemble(spark.createDataFrame([(i, float(a), float(np.sign(np.sin(3 * a)) * 5)) for i, a in enumerate(x)], "id long, a double, label double"), ["a"])
    found = {json.loads(r.params)["depth"]: r for r in models.search(df, "id", "Random Forest", {"trees": [10], "depth": [3, 4, 8]}, folds=2).collect()}
    assert sorted(r.rung for r in found.values()) == [0, 0, 1]
    assert found[3].place > 1 and max(found.values(), key=lambda r: (r.rung, r.mean)).place == 1
    with pytest.raises(ValueError, match="depth"):
        models.search(df, "id", "Random Forest", {"depth": [50]})


def test_search_and_compare(rows):
    train, test = (rows.where(F.col("id") % 5 != 0), rows.where(F.col("id") % 5 == 0))
    got = {r.model: r for r in models.search_and_compare(train, test, "id", {"Ridge Regression": {"alpha": [0.01, 10.0]}}, names=["Linear Regression", "Ridge Regression"]).collect()}
    assert got["Linear Regression"].status == "Default" and got["Linear Regression"].params is None
    assert got["Ridge Regression"].status == "TUNED" and json.loads(got["Ridge Regression"].params)["alpha"] in (0.01, 10.0)
