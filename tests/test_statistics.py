"""Descriptive statistics, normality, transforms, bivariate analyses."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tabwright.operators import bivariate, cluster, describe, normality
from tabwright.plans import ranks

from .conftest import one

WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def numbers(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=1, max_size=40))
def test_counts_add_up(spark, cells):
    df = numbers(spark, cells)
    n = sum(c is not None for c in cells)
    assert describe.histogram(df, "x", 7).agg(F.sum("cnt")).first()[0] == n
    assert (describe.frequency_table(df, "x").agg(F.sum("cnt")).first()[0] or 0) == n
    assert (describe.top_with_others(df, "x").agg(F.sum("cnt")).first()[0] or 0) == n


def test_histogram_of_a_constant(spark):
    rows = describe.histogram(numbers(spark, [3, 3, 3]), "x", 4).orderBy("bin").collect()
    assert [r.cnt for r in rows] == [0, 0, 3, 0] and rows[0].low == 2.5 and rows[-1].high == 3.5


def test_summaries_of_tiny_tables(spark):
    row = one(describe.numeric_summary_full(numbers(spark, [2, None]), "x"))
    assert (row["count"], row["missing"], row["median"], row["std"]) == (1, 1, 2.0, None)
    row = one(describe.categorical_summary(numbers(spark, [None]), "x"))
    assert row == {"total": 0, "unique": 0, "most_common": None, "most_common_count": None, "missing": 1}
    assert one(describe.numeric_summary(spark.createDataFrame([("1",), ("2 ",), ("x",)], "x string"), "x"))["mean"] == 1.5


def test_frequency_bar(spark):
    rows = describe.frequency_table(numbers(spark, [1, 1, 1, 2]), "x").collect()
    assert [(r.value, r.cnt, r.pct, len(r.bar)) for r in rows] == [(1.0, 3, 75.0, 37), (2.0, 1, 25.0, 12)]


def test_density_integrates_to_one(spark):
    rows = describe.density_curve(numbers(spark, np.random.default_rng(1).normal(0, 1, 500)), "x").orderBy("point").collect()
    assert len(rows) == 1000
    assert sum(r.density for r in rows) * (rows[1].x - rows[0].x) == pytest.approx(1, abs=1e-3)


def test_shapiro_published_example(spark):
    row = one(normality.shapiro_wilk(numbers(spark, WEIGHTS), "x"))
    assert row["w"] == pytest.approx(0.78881, abs=1e-5)
    assert row["p"] == pytest.approx(0.006704, abs=1e-6)
    assert not row["normal"] and row["p_reliable"]
    assert normality.shapiro_wilk(numbers(spark, [1, 2, 3]), "x").count() == 0


@pytest.mark.parametrize("partitions", [1, 16])
def test_rank_statistics_with_ties(spark, monkeypatch, partitions):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 30)
    monkeypatch.setattr(normality, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 0.5), rng.normal(0, 1, 800).round(2)])
    df = numbers(spark, x).repartition(partitions)
    ordered, n = np.sort(x), len(x)
    from statistics import NormalDist

    z = (ordered - x.mean()) / x.std(ddof=1)
    i = np.arange(1, n + 1)
    left = np.array([math.log(NormalDist().cdf(v)) for v in z])
    right = np.array([math.log(NormalDist().cdf(-v)) for v in z])
    a2 = -n - ((2 * i - 1) * left + (2 * (n - i) + 1) * right).sum() / n
    assert one(normality.anderson_darling(df, "x"))["a2"] == pytest.approx(a2, rel=1e-6)
    p = (i - 0.3175) / (n + 0.365)
    p[0], p[-1] = 1 - 0.5 ** (1 / n), 0.5 ** (1 / n)
    q = np.array([NormalDist().inv_cdf(v) for v in p])
    slope, intercept = np.polyfit(q, ordered, 1)
    rows = normality.qq_points(df, "x", 100).orderBy("rank").collect()
    assert len(rows) == 100 and rows[0].rank == 0 and rows[-1].rank == n - 1
    assert all(r.value == ordered[r.rank] and r.theoretical == pytest.approx(q[r.rank]) for r in rows)
    assert (rows[0].slope, rows[0].intercept) == pytest.approx((slope, intercept))


@pytest.mark.parametrize(
    "method, values, wanted",
    [
        ("Log", [1, 2, 3, 100, 200], [0, 0.693147, 1.098612, 4.60517, 5.298317]),
        ("Square Root", [1, 4, 9, 16, 100], [1, 2, 3, 4, 10]),
        ("Z-Score", [10, 20, 30, 40, 50], [-1.264911, -0.632456, 0, 0.632456, 1.264911]),
        ("Min-Max", [10, 20, 30, 40, 50], [0, 0.25, 0.5, 0.75, 1]),
        ("Z-Score", [7, 7, 7], [None, None, None]),
    ],
)
def test_transforms(spark, method, values, wanted):
    rows = normality.transform(numbers(spark, [*values, None]), "x", method).orderBy("i").collect()
    assert [None if r.transformed is None else round(r.transformed, 6) for r in rows] == wanted


@pytest.mark.parametrize("method, values", [("Log", [0, 1]), ("Square Root", [-1, 1]), ("Box-Cox", [-1, 2]), ("Yeo-Johnson", [3, 3])])
def test_transform_preconditions(spark, method, values):
    with pytest.raises(normality.TransformError):
        normality.transform(numbers(spark, values), "x", method)


def test_power_search_finds_the_log(spark):
    x = np.exp(np.random.default_rng(5).normal(0, 0.5, 4000))
    assert normality.search_lambda(numbers(spark, x), "x", "Box-Cox") == pytest.approx(0, abs=0.06)
    # An optimum outside the first grid.
    far = np.random.default_rng(5).normal(50, 2, 4000) ** (1 / 5)
    assert normality.search_lambda(numbers(spark, far), "x", "Box-Cox") == pytest.approx(5, abs=2.5)


def test_advice(spark):
    def methods(x):
        return [r.method for r in normality.recommend_transform(numbers(spark, x), "x").orderBy("place").collect()]

    assert methods([1] * 50 + [1000]) == ["Log", "Box-Cox", "Yeo-Johnson"]
    assert methods([0] * 50 + [1000]) == ["Yeo-Johnson", "Box-Cox"]
    assert methods([1, 2, 3, 4]) == ["Z-Score", "Min-Max"]


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, "2", 5.0), (2.0, "4", 5.0), (3.0, "x", 5.0), (4.0, "1", 5.0)], "a double, b string, k double")
    found = {(r.a, r.b): r.r for r in bivariate.correlation_matrix(df).collect()}
    assert len(found) == 9 and found["a", "k"] is None and found["k", "k"] is None
    assert found["a", "b"] == found["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 1])[0, 1])


def test_correlation_of_many_columns_with_gaps_in_one_scan(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(400, 5))
    x = base @ rng.normal(size=(5, 40)) + rng.normal(size=(400, 40)) + 1e7
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.where(np.arange(400) < 200, 0.3, x[:, 8])
    x[:200, 9] = 1e7 + np.arange(200)
    x[200:, 9] = np.nan
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    result = bivariate.correlation_matrix(df.repartition(7))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    found = {(r.a, r.b): r.r for r in result.collect()}
    assert len(found) == 1600
    for i in range(40):
        for j in range(40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
                assert found[names[i], names[j]] is None, (i, j)
            else:
                assert found[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9), (i, j)
    empty = bivariate.correlation_matrix(df.limit(0).select("c0", "c1")).collect()
    assert sorted((r.a, r.b, r.r) for r in empty) == [(a, b, None) for a in ("c0", "c1") for b in ("c0", "c1")]


def test_anova_against_closed_form(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1, 300), "b": rng.normal(0.1, 1, 20), "c": rng.normal(0, 2, 40)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 9.0), ("a", None), ("z", None)]
    row = one(bivariate.anova_oneway(spark.createDataFrame(rows, "g string, x double"), "x", "g"))
    every = np.concatenate(list(groups.values()))
    between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in groups.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (len(every) - 3)
    assert row["f"] == pytest.approx(between / within) and row["groups"] == 3
    single = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double")
    assert bivariate.anova_oneway(single, "x", "g").count() == 0


def test_regression_needs_three_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    assert bivariate.simple_regression(df, "x", "y").count() == 0
    more = df.union(spark.createDataFrame([(3.0, 6.0)], "x double, y double"))
    assert one(bivariate.simple_regression(more, "x", "y"))["equation"] == "Y = 0.0000 + 2.0000*X"


def test_kmeans_separates_blobs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c * 10 + e), None if i % 11 == 0 else float(c * 10 - e)) for i, (c, e) in enumerate((c, rng.normal()) for c in range(3) for _ in range(60))]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    result = cluster.kmeans(df, ["a", "b"], 3, n_init=4)
    pairs = result.labelled.where("b is not null").selectExpr("cluster", "floor((i) / 60) as blob").distinct()
    assert pairs.count() == 3
    assert one(cluster.kmeans_summary(result))["samples"] == 180
    with pytest.raises(ValueError):
        cluster.kmeans(df, ["a", "b"], 11)


def test_kmeans_starts_advance_together(spark):
    """Every start is Lloyd's algorithm from its own centres; the best one is kept, whatever the partitioning."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 2)) + rng.integers(0, 4, (400, 1)) * [4, -3]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double")
    result = cluster.kmeans(df.repartition(5), ["a", "b"], 4, n_init=6)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    points = np.array(result.model.clusterCenters())
    far = ((z[:, None] - points[None]) ** 2).sum(axis=2)
    labels = {r.i: r.cluster for r in result.labelled.collect()}
    assert [labels[i] for i in range(400)] == far.argmin(axis=1).tolist()
    assert result.inertia == pytest.approx(far.min(axis=1).sum()) and result.inertia == min(result.costs) and len(result.costs) == 6
    again = cluster.kmeans(df.repartition(2), ["a", "b"], 4, n_init=6)
    assert again.inertia == pytest.approx(result.inertia, rel=1e-9) and again.iterations == result.iterations
    # A centre is the mean of its rows, but for the last small step.
    assert all(np.abs(z[far.argmin(axis=1) == k].mean(axis=0) - p).max() < 0.02 for k, p in enumerate(points))


def test_kmeans_of_one_point(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    result = cluster.kmeans(df, ["a", "b"], 2, n_init=2)
    assert result.inertia == 0 and result.labelled.select("cluster").distinct().count() == 1
