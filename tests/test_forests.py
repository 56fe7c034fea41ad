"""Forests without a bound on depth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import forests
from tabwright.operators.models import assemble, train_random_forest_classifier


def _plain_split(x, y, w, classes):
    """The best split of one node by trying every border of every feature."""
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            here = x[:, f] <= v
            score = sum((np.bincount(y[m], w[m], classes) ** 2).sum() / w[m].sum() for m in (here, ~here))
            if best is None or score > best[0] + 1e-9:
                best = (score, f, here)
    return best


def _depth(tree):
    depth = np.zeros(len(tree["feature"]), int)
    for i in np.flatnonzero(tree["feature"] >= 0):
        depth[tree["left"][i] : tree["left"][i] + 2] = depth[i] + 1
    return depth.max()


def test_first_split_is_the_best_one_and_leaves_are_pure():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 3, 60)
        w = rng.poisson(1, 60).astype(float)
        tree = forests.grow(x, y, w, 3, 3, 1, np.random.default_rng(1))
        kept = w > 0
        score, _, _ = _plain_split(x[kept], y[kept], w[kept], 3)
        here = x[kept, tree["feature"][0]] <= tree["threshold"][0]
        assert score == pytest.approx(sum((np.bincount(y[kept][m], w[kept][m], 3) ** 2).sum() / w[kept][m].sum() for m in (here, ~here)))
        shares = forests.descend(tree, x[kept])
        for i, point in enumerate(x[kept]):
            same = (x[kept] == point).all(axis=1)
            assert shares[i] == pytest.approx(np.bincount(y[kept][same], w[kept][same], 3) / w[kept][same].sum())


def test_trees_grow_deeper_than_thirty_levels():
    # Classes take turns and every row outweighs those after it, so each split parts one row from the rest.
    n = 45
    x, y = np.arange(n)[:, None] * 1.0, np.arange(n) % 2
    tree = forests.grow(x, y, 2.0 ** np.arange(n)[::-1], 2, 1, 1, np.random.default_rng(1))
    assert _depth(tree) > 30 and (forests.descend(tree, x).argmax(axis=1) == y).all()


def test_features_that_part_nothing_do_not_end_a_branch():
    x = np.zeros((40, 9))
    x[:, 4] = np.arange(40)
    tree = forests.grow(x, np.arange(40) % 2, np.ones(40), 2, 1, 1, np.random.default_rng(2))
    assert (tree["share"][tree["feature"] < 0].max(axis=1) == 1).all()


def test_smallest_leaf():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 2)), rng.integers(0, 2, 300)
    tree = forests.grow(x, y, np.ones(300), 2, 2, 20, rng)
    at = forests.descend({**tree, "share": np.arange(len(tree["feature"]))}, x)
    assert np.bincount(at)[np.bincount(at) > 0].min() >= 20


@pytest.fixture(scope="module")
def rings(spark):
    """Rings around the origin, and a third of all rows on one point."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (2000, 2))
    y = (np.floor(np.hypot(*x.T) * 3) % 2).astype(float)
    rows = [(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, y))] + [(2000 + i, 5.0, 5.0, 1.0) for i in range(1000)]
    return assemble(spark.createDataFrame(rows, "id long, a double, b double, label double"), ["a", "b"])


@pytest.mark.parametrize("rows", [200_000, 300])
def test_forest_learns_rings_with_and_without_upper_levels(spark, monkeypatch, rings, rows):
    monkeypatch.setattr(forests, "ROWS_PER_GROUP", rows)
    monkeypatch.setattr(forests, "MOST_ROWS", rows * 5)
    train, test = rings.where("id % 4 > 0"), rings.where("id % 4 = 0")
    model = train_random_forest_classifier(train, trees=20)
    assert (model.top is None) == (rows > 3000)
    out = model.transform(test).select("id", "label", "prediction", "prediction_probability").collect()
    # No worse than Spark's forest of the same size and its greatest depth, but for the chance of the draws.
    bounded = train_random_forest_classifier(train, trees=20, depth=30).transform(test).select("label", "prediction").collect()
    right, least = (np.mean([r.label == r.prediction for r in rows_]) for rows_ in (out, bounded))
    assert len(out) == test.count() and right > least - 0.03, (right, least)
    assert all(sum(r.prediction_probability) == pytest.approx(1) and r.prediction_probability[int(r.prediction)] == max(r.prediction_probability) for r in out)
    again = train_random_forest_classifier(train.repartition(7), trees=20)
    if rows > 3000:
        assert {r.id: r.prediction for r in out} == {r.id: r.prediction for r in again.transform(test).collect()}


def test_rows_travel_in_packs_to_every_tree(spark, rings):
    points = rings.groupBy(F.array("a", "b").alias("x"), F.col("label").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w")).repartition(4)
    packs = forests._packs(None, points, 3, 200).collect()
    # One row for each pack and tree, not for each point and tree.
    assert len(packs) <= 3 * (4 + 2001 // 200) and {(r.tree, r.root) for r in packs} == {(0, 0), (1, 0), (2, 0)}
    whole = sorted((*r.x, r.y, r.w) for r in points.collect())
    for tree in range(3):
        got = [(*np.reshape(r.x, (-1, 2))[i], r.y[i], r.w[i]) for r in packs if r.tree == tree for i in range(len(r.place))]
        assert sorted(got) == whole
    assert all(sorted(r.place) == list(range(len(r.place))) for r in packs)


@pytest.mark.parametrize("rows", [200_000, 300])
def test_packs_of_any_size_descend_alike(rings, monkeypatch, rows):
    monkeypatch.setattr(forests, "ROWS_PER_GROUP", rows)
    monkeypatch.setattr(forests, "MOST_ROWS", rows * 5)
    model = train_random_forest_classifier(rings.where("id % 4 > 0"), trees=8)
    test, found = rings.where("id % 4 = 0 and id < 2100"), []
    for most in (20_000, 7):
        monkeypatch.setattr(forests, "DESCEND_PACK", most)
        found.append({r.id: tuple(r.prediction_probability) for r in model.transform(test).select("id", "prediction_probability").collect()})
    assert found[0] == found[1] and len(found[0]) == test.count()


def test_levels_part_what_is_sorted():
    rng = np.random.default_rng(6)
    parent, value = rng.integers(0, 5, 300), rng.random(300)
    node = 2 * parent + rng.integers(0, 2, 300)
    parted = forests._parted(np.lexsort((value, parent)), node, 10)
    assert np.array_equal(parted, np.lexsort((value, node)))
