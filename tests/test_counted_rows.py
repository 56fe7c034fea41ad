"""Equal rows are counted, not repeated; small sides are sent to the large ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabwright.operators import cluster, coltypes, forests, models, neighbors, networks, prep, quality


@pytest.fixture(scope="module")
def grid(spark):
    """Nine inputs with 40 labels each, and one with a third of all rows."""
    rng = np.random.default_rng(4)
    rows = [(i, float(i % 3), float(i % 9 // 3), float(10 * (i % 3) + rng.normal())) for i in range(360)]
    rows += [(360 + i, 7.0, 7.0, float(rng.normal())) for i in range(180)]
    return models.assemble(spark.createDataFrame(rows, "id long, a double, b double, label double"), ["a", "b"]).persist()


def test_boosting_sees_each_input_once(grid):
    with models._counted(grid, "features", "label", means=True) as rows:
        assert rows.count() == 10 and rows.agg(F.sum(models.WEIGHT)).first()[0] == 540
    scored = models.train_gbt_regressor(grid, rounds=5, depth=3).transform(grid)
    assert models.regression_metrics(scored).first().r2 > 0.9


def test_counted_rows_leave_a_logistic_optimum(grid):
    rows = grid.withColumn("label", (F.col("label") > 5).cast("double"))
    twice = models.train_logistic_regression(rows.union(rows), cost=0.5)
    once = models.train_logistic_regression(rows, cost=1.0)
    assert np.allclose(once.coefficients.toArray(), twice.coefficients.toArray(), atol=1e-4)


def test_a_tree_over_counted_inputs_is_the_tree_over_rows():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (400, 2)).astype(float)
    y = x[:, 0] * 3 + (x[:, 1] > 2) + rng.normal(0, 0.1, 400)
    y -= y.mean()
    points, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    whole = forests.grow_means(x, np.ones(400), y, 4, 1)
    counted = forests.grow_means(points, np.bincount(of).astype(float), np.bincount(of, y), 4, 1)
    assert all(np.allclose(whole[c], counted[c]) for c in whole)
    assert np.allclose(forests.descend(forests.grow_means(points, np.bincount(of).astype(float), np.bincount(of, y), 10, 1), points), np.bincount(of, y) / np.bincount(of))


def test_regression_forest_draws_every_row(grid, monkeypatch):
    model = models.train_random_forest_regressor(grid, trees=20, depth=6)
    assert isinstance(model, forests.MeanForest) and len(model.trees) == 20
    assert models.regression_metrics(model.transform(grid)).first().r2 > 0.9
    monkeypatch.setattr(forests, "ROWS_PER_GROUP", 5)
    assert not isinstance(models.train_random_forest_regressor(grid, trees=2, depth=3), forests.MeanForest)


def test_regression_forest_over_many_distinct_inputs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c % 3), float(10 * (a > 0.3) + 5 * (b > 0.7) + c % 3)) for c, (a, b) in enumerate(rng.random((3000, 2)))]
    table = models.assemble(spark.createDataFrame(rows, "a double, b double, c double, label double"), ["a", "b", "c"])
    monkeypatch.setattr(forests, "CUTS", 32)
    monkeypatch.setattr(forests, "FEWEST_CUTS", 8)
    monkeypatch.setattr(forests, "ROWS_PER_GROUP", 1000)
    model = models.train_random_forest_regressor(table, trees=5, depth=6)
    assert isinstance(model, forests.MeanForest)
    assert models.regression_metrics(model.transform(table)).first().r2 > 0.9
    # Labels and rows are kept; an input of few values keeps them all, the others are raised to their cuts.
    given = table.select(F.array("a", "b", "c").alias("x"), F.col("label").alias("y"))
    raised = forests._between_cuts(given, 3).collect()
    assert sorted(r.y for r in raised) == sorted(r[3] for r in rows) and len({tuple(r.x) for r in raised}) <= 1100
    assert {r.x[2] for r in raised} == {0.0, 1.0, 2.0}
    assert 8 <= len({r.x[0] for r in raised}) <= 16 and max(r.x[0] for r in raised) == max(r[0] for r in rows)


def test_a_cut_parts_raised_values_as_it_parts_values():
    cuts = np.array([0.2, 0.5, 0.9])
    x = np.array([0.1, 0.2, 0.3, 0.5, 0.6, 0.9])
    batch = pa.RecordBatch.from_arrays([pa.array([[v] for v in x]), pa.array(x)], names=["x", "y"])
    (raised,) = forests._raised([cuts], [batch])
    made = np.array(raised.column(0).to_pylist()).ravel()
    assert made.tolist() == [0.2, 0.2, 0.5, 0.5, 0.9, 0.9] and raised.column(1).to_pylist() == x.tolist()
    assert all(((x <= c) == (made <= c)).all() for c in cuts)
    assert forests._thinned(np.arange(100.0), 10)[-1] == 99 and len(forests._thinned(np.arange(100.0), 10)) == 10


@pytest.mark.parametrize(("epsilon", "rows"), [(None, 10), (0.1, 540)])
def test_gradient_of_shared_inputs(grid, monkeypatch, epsilon, rows):
    monkeypatch.setattr(networks, "HOT", 50)
    monkeypatch.setattr(networks, "CELLS", 64)
    table = grid.select(F.array("a", "b").alias("x"), F.col("label").alias("y"))
    kernel = networks.find_landmarks(grid, "features", 0.5)
    local = table.toPandas()
    x, y = np.stack(local.x.to_numpy()), local.y.to_numpy()
    objective = networks.Objective(table, 2, networks._shapes(kernel.width, []), 0.1, epsilon, kernel)
    assert objective.rows.count() == rows

    def whole(w):
        error = kernel.features(x) @ w[:-1] + w[-1] - y
        over = np.maximum(np.abs(error) - (epsilon or 0), 0)
        corner = objective.corner
        loss = error**2 / 2 if epsilon is None else np.where(over < corner, over**2 / (2 * corner), over - corner / 2)
        return loss.mean() + 0.05 * (w[:-1] ** 2).sum()

    flat = np.random.default_rng(3).normal(0, 1, kernel.width + 1)
    loss, slope = objective(flat)
    objective.close()
    assert loss == pytest.approx(whole(flat), rel=1e-9)
    assert slope == pytest.approx([(whole(flat + 1e-6 * e) - whole(flat - 1e-6 * e)) / 2e-6 for e in np.eye(len(flat))], rel=1e-3, abs=1e-5)


def test_neighbours_of_equal_points_are_found_once(grid):
    assert neighbors.points_of(grid, ["a", "b"], "id").count() == 10
    assert neighbors.offers_of(grid, ["a", "b"], "label", "id", 3).count() == 30
    found = neighbors.nearest_neighbours(grid, grid, ["a", "b"], "label", "id", 3).collect()
    assert len(found) == 540 and all(n.d == 0 for r in found for n in r.neighbours)
    assert {tuple(n._train for n in r.neighbours) for r in found if r.id >= 360} == {(360, 361, 362)}


def test_nearest_centre_by_products_is_that_by_differences():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 8)) + 1e6, np.zeros((3, 8))])
    points = np.concatenate([x[:4], x[:2], x[500:501]])
    assert np.array_equal(cluster._nearest(x, points), cluster._distances(x, points).argmin(axis=1))


def _sent(spark, df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_levels_and_limits_are_sent_to_the_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i, None if i % 7 == 0 else "xyz"[i % 3]) for i in range(60)], "id long, t string")
        codes = coltypes.factorize(rows, "t", ["id"])
        assert _sent(spark, codes)
        assert {(r.t, r.code) for r in codes.collect()} == {(None, -1), ("y", 0), ("z", 1), ("x", 2)}
        texts = spark.createDataFrame([("a" * 70 + f" #{i}",) for i in range(30)] + [("plain",)], "text string")
        report = quality.special_char_report(texts, {"text": "text"})
        assert _sent(spark, report)
        row = report.first()
        assert row.issues == 30 and row.examples == sorted("a" * 70 + f" #{i}" for i in range(30))[:10]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_numbered_once_for_resamples(spark, monkeypatch):
    calls = []
    settle = prep.settle
    monkeypatch.setattr(prep, "settle", lambda df: calls.append(1) or settle(df))
    rows = spark.range(50).withColumnRenamed("id", "k")
    assert prep.bootstrap_augment(rows, "k", 2).count() == 100 and calls == [1]


def test_stacked_inputs_are_kept_for_the_fit(grid, monkeypatch):
    kept = []
    shared = models.shared
    monkeypatch.setattr(models, "shared", lambda df, *rest: kept.append(df.columns) or shared(df, *rest))
    stacked = models.stacking_regressor(grid, grid, params={"Random Forest": {"trees": 3, "depth": 3}, "Ridge Regression": {}})
    assert ["meta", "label"] in kept and models.regression_metrics(stacked).first().r2 > 0.9
