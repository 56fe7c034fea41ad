"""Ranks, quantiles, numbering: against brute force, on skewed data and any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.plans import ranks
from tabwright.plans.ranks import exact_quantiles, number_in_order, number_rows, order_buckets, value_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, a third come from one group."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(4000, 5.0), rng.normal(0, 100, 4000).round(1), rng.exponential(3, 4000)])
    rng.shuffle(x)
    g = np.where(np.arange(12000) % 3 == 0, "hot", np.char.add("g", (np.arange(12000) % 50).astype(str)))
    return spark.createDataFrame([(i, str(a), float(b)) for i, (a, b) in enumerate(zip(g, x))], "id long, g string, x double").cache()


def many_buckets(monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 50)


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_value_ranks(skewed, monkeypatch, partitions):
    many_buckets(monkeypatch)
    x = np.sort(np.array([r.x for r in skewed.select("x").collect()]))
    rows = value_ranks(skewed.repartition(partitions), "x").collect()
    assert sum(r.cnt for r in rows) == len(x)
    for r in rows:
        assert r.before == np.searchsorted(x, r.x) and r.total == len(x)


def test_value_ranks_by_group(skewed, monkeypatch):
    many_buckets(monkeypatch)
    local = skewed.toPandas()
    groups = {g: np.sort(d.x.to_numpy()) for g, d in local.groupby("g")}
    for r in value_ranks(skewed, "x", ["g"]).collect():
        assert r.before == np.searchsorted(groups[r.g], r.x) and r.total == len(groups[r.g])


@pytest.mark.parametrize("small, gather", [(10**9, 1), (0, 10**9), (0, 100), (0, 1)])
def test_exact_quantiles(skewed, small, gather):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    both = skewed.withColumn("y", -F.col("x") * 3).withColumn("nothing", F.lit(None).cast("double"))
    found = exact_quantiles(both, ["x", "y", "nothing"], probs, small, gather)
    x = np.array([r.x for r in skewed.select("x").collect()])
    assert found["x"] == pytest.approx(np.quantile(x, probs).tolist())
    assert found["y"] == pytest.approx(np.quantile(-3 * x, probs).tolist())
    assert found["nothing"] == [None] * len(probs)


def test_number_rows_is_dense_and_stable(skewed):
    first = {r.id: r._row for r in number_rows(skewed, "id").collect()}
    again = {r.id: r._row for r in number_rows(skewed.repartition(13), "id").collect()}
    assert first == again and sorted(first.values()) == list(range(12000))
    by = number_rows(skewed, "id", ["g"]).groupBy("g").agg(F.min("_row").alias("a"), F.max("_row").alias("b"), F.count("*").alias("n"))
    assert all(r.a == 0 and r.b == r.n - 1 for r in by.collect())


def test_number_in_order_with_a_hot_order_value(skewed, monkeypatch):
    many_buckets(monkeypatch)
    wanted = {r.id: i for i, r in enumerate(sorted(skewed.collect(), key=lambda r: (r.x, r.id)))}
    assert {r.id: r._row for r in number_in_order(skewed, ["x", "id"]).collect()} == wanted


def test_hot_order_value_is_split(skewed, monkeypatch):
    many_buckets(monkeypatch)
    sizes = order_buckets(skewed, ["x", "id"]).groupBy("_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 500


@pytest.mark.parametrize("per_bucket", [50_000, 7])
def test_text_order_keys(spark, monkeypatch, per_bucket):
    """Texts with a long common start, a crowded start, and ones beyond ASCII are numbered in byte order."""
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", per_bucket)
    names = [f"item-{k:09d}" for k in range(120)] + [f"item-zzzzzz{k:05d}" for k in range(200)] + ["item-", "item-é", "item-日本", "item-a", "item-aa"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    got = {r.name: r["_row"] for r in ranks.number_in_order(df, ["name"]).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=str.encode))}
