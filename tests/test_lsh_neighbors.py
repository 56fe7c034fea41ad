"""Approximate neighbours against brute force."""

import numpy as np
import pytest

from tabwright.operators import lsh_neighbors, neighbors

NAMES = [f"f{i}" for i in range(6)]


def _table(spark, x, first=0):
    rows = [(first + i, *map(float, r), float(i % 3)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in NAMES) + ", label double")


def _exact(train, test, k):
    d = np.sqrt(((test[:, None, :] - train[None]) ** 2).sum(axis=2))
    return [np.lexsort((np.arange(len(train)), row))[:k] for row in d]


@pytest.fixture(scope="module")
def clusters():
    """Clumps of several widths, and a third of all training rows on one point."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 20, (40, 6))
    spots = centres[rng.integers(0, 40, 4400)] + rng.normal(0, 1, (4400, 6)) * rng.choice([0.5, 1.0, 3.0], (4400, 1))
    train = np.concatenate([spots[:4000], np.zeros((2000, 6))])
    return train, np.concatenate([spots[4000:], np.zeros((20, 6))])


def test_recall_is_met_and_distances_are_exact(spark, monkeypatch, clusters):
    monkeypatch.setattr(neighbors, "TRAIN_BLOCK", 300)
    monkeypatch.setattr(neighbors, "TEST_BLOCK", 50)
    monkeypatch.setattr(lsh_neighbors, "CANDIDATES", 200)
    train, test = clusters
    a, b = _table(spark, train), _table(spark, test, 100_000)
    plan = lsh_neighbors.fit_projections(a, b, NAMES, "label", "id", 5, 0.95)
    assert plan.directions.shape[1] > 1 and plan.recall >= 0.95 and plan.trials[-1][0] == len(plan.directions)
    # The tables leave most training rows out: a test row off the crowded point meets less than a quarter of them.
    cells, visits = plan.own(train[:4000]), plan.visited(test[:-20]).reshape(len(test) - 20, len(plan.directions), -1)
    meet = np.zeros((len(visits), len(cells)), bool)
    for t in range(len(plan.directions)):
        for v in range(visits.shape[2]):
            meet |= visits[:, t, v][:, None] == cells[:, t][None]
    assert meet.mean() < 0.25
    found = {r.id: r.neighbours for r in lsh_neighbors.approximate_neighbours(a, b, NAMES, "label", "id", 5, projections=plan).collect()}
    assert len(found) == len(test)
    met = 0
    for i, best in enumerate(_exact(train, test, 5)):
        near = found[100_000 + i]
        assert len(near) == 5 and len({n._train for n in near}) == 5
        for n in near:
            assert n.d == pytest.approx(np.sqrt(((train[n._train] - test[i]) ** 2).sum()), abs=1e-9)
        met += len({n._train for n in near} & set(best.tolist()))
    assert met >= 0.95 * 5 * len(test)
    # Copies of one point: the smallest keys.
    assert [n._train for n in found[100_000 + len(test) - 1]] == [4000, 4001, 4002, 4003, 4004]


def test_blocks_do_not_change_the_result(spark, monkeypatch, clusters):
    train, test = clusters
    a, b = _table(spark, train[:1500]), _table(spark, test[:60], 100_000)
    plan = lsh_neighbors.Projections.drawn(6, 2, 2, 30.0, 4, 1)
    rows = []
    for block in (100_000, 40):
        monkeypatch.setattr(neighbors, "TRAIN_BLOCK", block)
        monkeypatch.setattr(neighbors, "TEST_BLOCK", block)
        rows.append(sorted((r.id, r.neighbours) for r in lsh_neighbors.approximate_neighbours(a, b, NAMES, "label", "id", 3, projections=plan).collect()))
    assert rows[0] == rows[1]


def test_lonely_rows_are_answered_exactly(spark):
    train, test = np.arange(36).reshape(6, 6) * 1.0, np.full((2, 6), 1e6)
    test[1] = 0
    plan = lsh_neighbors.Projections.drawn(6, 3, 1, 0.01, 1, 1)
    out = lsh_neighbors.approximate_neighbours(_table(spark, train), _table(spark, test, 50), NAMES, "label", "id", 9, projections=plan)
    assert {r.id: [n._train for n in r.neighbours] for r in out.collect()} == {50: [5, 4, 3, 2, 1, 0], 51: [0, 1, 2, 3, 4, 5]}


def test_votes_and_equal_points_alone(spark):
    a = _table(spark, np.zeros((9, 6)))
    out = lsh_neighbors.lsh_classifier(a, _table(spark, np.zeros((3, 6)), 50), NAMES, "label", "id", 4).collect()
    assert [r.prediction for r in out] == [0.0] * 3
