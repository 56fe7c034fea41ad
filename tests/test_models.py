"""Preparation, models, neighbours and networks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import models, neighbors, prep

from .conftest import one


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [1, 3, 0.5], (400, 3))
    y = x @ [2.0, -1.0, 0.3] + 5 + rng.normal(0, 0.5, 400)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double").cache()


def arrays(df):
    local = df.toPandas()
    return local[["a", "b", "c"]].to_numpy(), local.label.to_numpy()


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    for share, wanted in ((0.1, 101), (0.2, 201), (0.5, 502)):
        train, test = prep.train_test_split(df, "k", share)
        a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
        assert len(b) == wanted and not a & b and len(a | b) == 1003
    again = prep.train_test_split(df.repartition(17), "k", 0.5)[1]
    assert {r.k for r in again.collect()} == b
    assert {r.k for r in prep.train_test_split(df, "k", 0.5, seed=1)[1].collect()} != b
    with pytest.raises(ValueError):
        prep.train_test_split(df, "k", 0.05)


def test_split_does_not_move_rows(spark):
    train, _ = prep.train_test_split(spark.range(1000).withColumn("payload", F.col("id") * 2), "id")
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    outer = plan.split("scalar-subquery")[0]
    assert "Join" not in outer and "Window" not in outer


def test_scaling_and_features(linear):
    train, test = prep.train_test_split(linear, "id")
    scaled, _ = prep.standard_scale(train, test, ["a", "b"])
    row = scaled.agg(F.avg("a"), F.stddev_pop("b")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)
    made = prep.interaction_features(prep.polynomial_features(linear, ["a"]), ["a", "b", "c"])
    assert made.columns[-5:] == ["a_squared", "a_cubed", "a_x_b", "a_x_c", "b_x_c"]
    noisy = linear.withColumn("noise", F.rand(1)).withColumn("k", F.lit(1.0))
    assert prep.weak_features(noisy, ["a", "b", "noise", "k"], "label") == ["noise"]


def test_binarize(spark, linear):
    assert prep.binarize_by_median(linear, "label", "y").where("y = 1").count() == 200
    with pytest.raises(ValueError):
        prep.binarize_by_median(spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "v double"), "v")


def test_outliers_ignore_constant_columns(spark):
    df = spark.createDataFrame([(float(i % 5), 1.0) for i in range(100)] + [(1000.0, 1.0)], "x double, k double")
    assert one(prep.outlier_counts(df, ["x", "k"])) == {"column": "x", "outliers": 1, "pct": 0.99}
    assert prep.remove_outliers(df, ["x", "k"]).count() == 100


def test_prepare_reports_dropped(spark):
    df = spark.createDataFrame([(1, "a", 2.0, "u"), (2, "b", None, "v")], "i int, t string, x double, y string")
    made = prep.prepare_xy(df, "y", ["t", "x"], ["i"])
    assert made.features == ["x"] and made.dropped == ["t"]
    assert [r.label for r in made.df.orderBy("i").collect()] == [0.0, 1.0]
    coded = prep.prepare_xy(df, "x", ["t"], ["i"])
    assert coded.features == ["t"] and [r.t for r in coded.df.orderBy("i").collect()] == [0.0, 1.0]


def test_augmentation(spark):
    df = spark.range(900).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as s")
    more = prep.bootstrap_augment(df, "id", 3)
    assert more.count() == 2700 and more.where("copy = 0").count() == 900
    assert more.select("id", "copy", "draw").distinct().count() == 2700
    strata = prep.stratified_augment(df, "id", "s", 3)
    sizes = strata.groupBy("s").pivot("copy", [0, 1, 2]).count().collect()
    assert all(r["0"] == r["1"] == r["2"] for r in sizes)
    assert prep.bootstrap_augment(df.repartition(11), "id", 3).exceptAll(more).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_closed_form(linear, alpha):
    x, y = arrays(linear)
    xc, yc = x - x.mean(0), y - y.mean()
    wanted = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    model = models.train_ridge(models.assemble(linear, ["a", "b", "c"]), alpha=alpha)
    assert model.coefficients.toArray() == pytest.approx(wanted, rel=1e-8)


@pytest.mark.parametrize("alpha, ratio", [(0.1, 1.0), (0.5, 0.5), (0.1, 0.2)])
def test_elastic_net_optimum(linear, alpha, ratio):
    x, y = arrays(linear)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / ((xc[:, j] ** 2).mean() + alpha * (1 - ratio))
    model = models.train_elastic_net(models.assemble(linear, ["a", "b", "c"]), alpha=alpha, l1_ratio=ratio)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-5)


def test_logistic_optimum(linear):
    df = models.assemble(prep.binarize_by_median(linear, "label", "y"), ["a", "b", "c"])
    model = models.train_logistic_regression(df, label_col="y")
    x, _ = arrays(df)
    y = np.array([r.y for r in df.select("y").collect()])
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # The gradient of sum(log loss) + |w|²/2 vanishes.
    assert x.T @ (p - y) + w == pytest.approx(np.zeros(3), abs=1e-3)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    assert one(models.classification_metrics(df)) == {"accuracy": 0.75, "precision": 1.0, "recall": 0.5, "f1": pytest.approx(2 / 3)}
    none = df.withColumn("prediction", F.lit(0.0))
    assert one(models.classification_metrics(none))["f1"] == 0.0
    row = one(models.regression_metrics(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")))
    assert row == {"r2": 0.5, "rmse": pytest.approx(0.5**0.5), "mae": 0.5}
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "label double, prediction double")
    assert one(models.regression_metrics(flat))["r2"] is None


def test_compare_tune_merge(linear):
    train, test = (models.assemble(d, ["a", "b", "c"]) for d in prep.train_test_split(linear, "id"))
    compared = models.compare_models(train, test, ["Lasso Regression", "Linear Regression", "Random Forest"], params={"Random Forest": {"trees": 5, "depth": 4}})
    assert one(models.best_model(compared, "r2"))["model"] == "Linear Regression"
    tuned = models.tune(train, test, "Lasso Regression", {"alpha": 0.001})
    assert one(tuned)["delta"] > 0
    status = {r.model: r.status for r in models.merge_tuned(compared, tuned).collect()}
    assert status == {"Lasso Regression": "TUNED", "Linear Regression": "Default", "Random Forest": "Default"}
    with pytest.raises(ValueError):
        models.tune(train, test, "Lasso Regression", {"alpha": 7.0})


def test_folds_keep_class_shares(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 10 = 0 then 1D else 0D end as label")
    folds = models.with_fold(df, "id", 5, "label").groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    assert {(r.n, r.ones) for r in folds.collect()} == {(200, 20.0)}


def test_ensembles(linear):
    train, test = (models.assemble(d, ["a", "b", "c"]) for d in prep.train_test_split(linear, "id"))
    small = {"Random Forest": {"trees": 5, "depth": 4}, "Gradient Boosting": {"rounds": 5}}
    assert one(models.regression_metrics(models.voting_regressor(train, test, params=small)))["r2"] > 0.8
    stacked = models.stacking_regressor(train, test, "id", True, 2, {"Random Forest": {"trees": 5, "depth": 4}, "Ridge Regression": {}})
    assert one(models.regression_metrics(stacked))["r2"] > 0.9
    classes = [prep.binarize_by_median(d, "label", "y").drop("label").withColumnRenamed("y", "label") for d in (train, test)]
    voted = models.soft_voting_classifier(*classes, params=small)
    assert one(models.classification_metrics(voted))["accuracy"] > 0.85


@pytest.mark.parametrize("kernel", ["rbf", "linear", "poly"])
def test_svm_separates(spark, kernel):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (500, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = models.assemble(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, label double"), ["a", "b"])
    model = models.train_svm_classifier(df.coalesce(1), kernel=kernel, landmarks=64, max_iter=12)
    assert one(models.classification_metrics(model.transform(df)))["accuracy"] > 0.93


def test_networks_learn_a_curve(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 2000)
    y = np.sin(2 * x) * 10 + 100
    df = models.assemble(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, label double").repartition(4), ["a"])
    net = models.train_mlp_regressor(df, max_iter=60)
    assert one(models.regression_metrics(net.transform(df)))["r2"] > 0.9
    svr = models.train_svr(df, max_iter=80)
    assert one(models.regression_metrics(svr.transform(df)))["r2"] > 0.9


@pytest.fixture
def crowded(spark):
    """A third of the rows lie on one point, many distances tie."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.zeros((400, 2)), rng.integers(-5, 6, (400, 2)), rng.normal(0, 20, (400, 2))])
    rows = [(i, *map(float, r), float(rng.integers(0, 3))) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, label double")


@pytest.mark.parametrize("per_pivot, block", [(2000, 4096), (20, 64)])
def test_neighbours_equal_brute_force(spark, monkeypatch, crowded, per_pivot, block):
    monkeypatch.setattr(neighbors, "ROWS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(neighbors, "TEST_BLOCK", block)
    monkeypatch.setattr(neighbors, "TRAIN_BLOCK", block * 2)
    train, test = prep.train_test_split(crowded, "id", 0.3)
    a, b = train.toPandas().sort_values("id"), test.toPandas()
    found = {r.id: [n._train for n in r.neighbours] for r in neighbors.nearest_neighbours(train, test, ["a", "b"], "label", "id", 5).collect()}
    points, ids = a[["a", "b"]].to_numpy(), a.id.to_numpy()
    for i, p in zip(b.id, b[["a", "b"]].to_numpy()):
        d = np.sqrt((points[:, 0] - p[0]) ** 2 + (points[:, 1] - p[1]) ** 2)
        assert found[i] == ids[np.lexsort((ids, d))[:5]].tolist()
    labels = dict(zip(a.id, a.label))
    for r in neighbors.knn_classifier(train, test, ["a", "b"], "label", "id", 5).collect():
        votes = [labels[t] for t in found[r.id]]
        assert r.prediction == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_few_training_rows(spark):
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0)], "id long, a double, label double")
    test = spark.createDataFrame([(3, 0.2, 0.0)], "id long, a double, label double")
    row = one(neighbors.nearest_neighbours(train, test, ["a"], "label", "id", 5))
    assert [n._train for n in row["neighbours"]] == [1, 2]


def test_grades(spark):
    df = spark.createDataFrame([(0.96,), (0.9,), (0.88,), (0.5,)], "s double")
    grade = lambda kind: [r.g for r in df.select(models.grade_performance(F.col("s"), kind).alias("g")).collect()]
    assert grade("Regression") == ["excellent", "good", "good", "poor"]
    assert grade("Classification") == ["excellent", "good", "good", "poor"]
    assert df.select(models.improvement_pct(F.lit(0.5), F.lit(-1.0)).alias("p")).first().p == 150.0


def test_unknown_kernels_are_refused(linear):
    rows = models.assemble(linear, ["a", "b", "c"])
    for train in (models.train_svr, models.train_svm_classifier):
        with pytest.raises(ValueError, match="kernel"):
            train(rows, kernel="sigmoid")


def test_polynomial_svr_learns_a_square(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, 600)
    rows = spark.createDataFrame([(float(v), float(v * v)) for v in x], "x double, label double")
    train = models.assemble(rows, ["x"])
    scores = {k: one(models.regression_metrics(models.train_svr(train, kernel=k, epsilon=0.01, max_iter=120).transform(train)))["r2"] for k in ("poly", "linear")}
    assert scores["poly"] > 0.95 and scores["linear"] < 0.2


def test_rbf_width_follows_the_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 5], (300, 2)) + [0, 10]
    rows = models.assemble(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"])
    assert models.rbf_gamma(rows, "features") == (2, pytest.approx(1 / (2 * x.var())))


def test_models_scale_inside(linear):
    """Inputs of very different size don't matter to models that need scaling, wherever they are trained."""
    rows = models.assemble(linear.withColumn("b", F.col("b") * 1e4 + 1e5), ["a", "b", "c"])
    score = models.cross_validate(rows, "id", "SVR (SVM)", folds=3, params={"kernel": "linear", "max_iter": 120})
    assert min(r.score for r in score.collect()) > 0.9


def test_neighbours_compare_tune_and_fold(linear):
    plain = prep.binarize_by_median(linear.withColumnRenamed("label", "price"), "price")
    train, test = (models.assemble(d, ["a", "b", "c"]) for d in prep.train_test_split(plain, "id"))
    rows = models.assemble(plain, ["a", "b", "c"])
    params = {"KNN": {"key": "id", "neighbors": 3}}
    got = models.compare_models(train, test, ["Naive Bayes", "KNN"], "Classification", params).collect()
    direct = neighbors.knn_classifier(train.drop("features"), test.drop("features"), ["a", "b", "c"], "label", "id", 3)
    assert got[1].accuracy == pytest.approx(one(models.classification_metrics(direct))["accuracy"]) and got[1].accuracy > 0.8
    folds = models.cross_validate(rows, "id", "KNN", "Classification", 3, {"key": "id"})
    assert folds.count() == 3 and min(r.score for r in folds.collect()) > 0.8
    with pytest.raises(ValueError, match="key"):
        models.compare_models(train, test, ["KNN"], "Classification")
    for name, bad in (("KNN", {"neighbors": 21}), ("SVM", {"cost": 0.01}), ("SVR (SVM)", {"cost": 2000.0}), ("Neural Network", {"hidden": (300, 50)})):
        with pytest.raises(ValueError):
            models.check_params(name, bad)
    models.check_params("Neural Network", {"hidden": (100, 50)})


def test_augmentation_of_training_rows_alone(linear):
    """With one nearest neighbour a copy in the training rows gives the label away; without copies it doesn't."""
    rng = np.random.default_rng(8)
    noise = [(int(i), float(rng.normal()), float(rng.integers(2))) for i in range(300)]
    rows = linear.sparkSession.createDataFrame(noise, "id long, a double, label double")
    before, after = (
        one(models.retrain_on(rows, ["a"], "id", "Random Forest", "augmented", problem="Classification", params={"trees": 5}, train_only=t)) for t in (False, True)
    )
    assert before["changed"] > after["changed"] + 0.05 and after["original"] == before["original"]


def test_kept_split_hashes_keys_once(spark):
    rows = spark.createDataFrame([(i % 40 if i % 50 else None, i) for i in range(700)], "k long, v long")
    plain, kept = prep.train_test_split(rows, "k"), prep.train_test_split(rows, "k", keep=True)
    for a, b in zip(plain, kept, strict=True):
        assert sorted(r.v for r in a.collect()) == sorted(r.v for r in b.collect())
        assert "md5" in a._jdf.queryExecution().optimizedPlan().toString() and "md5" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_retraining_splits_each_table_once(linear, monkeypatch):
    plans = []
    settle = prep.settle
    monkeypatch.setattr(prep, "settle", lambda df: plans.append(df.columns) or settle(df))
    models.retrain_on(linear, ["a", "b"], "id", "Linear Regression", "augmented").collect()
    assert sum("is_test" in columns for columns in plans) == 2
