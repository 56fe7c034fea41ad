"""Type detection, quality reports, sources and imputation on literal rows."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tabwright.operators import coltypes, impute, quality
from tabwright.plans import ranks
from tabwright.session import fresh_path
from tabwright.sources import tables

from .conftest import one


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "c string")


CASES = [
    ([None, None], "unknown"),
    (["5"], "categorical"),
    (["0", "1"] * 20, "categorical"),
    ([str(i) for i in range(1, 26)], "categorical"),
    ([str(i) for i in range(25)], "categorical"),
    ([str(i) for i in range(24)] + ["30"], "numeric"),
    ([str(i) for i in range(31)], "numeric"),
    ([str(i) for i in range(90)] + ["x"] * 10, "text"),
    ([str(i) for i in range(91)] + ["x"] * 9, "numeric"),
    ([f"2024-01-{d:02d}" for d in range(1, 29)], "date"),
    ([f"0{m}/{d}/2024" for m in range(1, 10) for d in range(10, 20)], "date"),
    ([f"w{i}" for i in range(20)], "categorical"),
    ([f"w{i % 49}" for i in range(100)], "categorical"),
    ([f"w{i % 50}" for i in range(100)], "text"),
    (["x" * 100 + str(i) for i in range(30)], "text"),
]


@pytest.mark.parametrize("texts, wanted", CASES)
def test_decision_list(spark, texts, wanted):
    assert coltypes.feature_types(column(spark, texts)) == {"c": wanted}


def test_typed_columns(spark):
    df = spark.sql("select id as a, cast(id % 2 = 0 as boolean) as b, timestamp_ntz'2024-01-01' as t, double('nan') as n from range(40)")
    assert coltypes.feature_types(df) == {"a": "numeric", "b": "categorical", "t": "date", "n": "unknown"}
    kinds = {r["column"]: r["feature_type"] for r in coltypes.detect_feature_types(df, approximate=True).collect()}
    assert kinds == {"a": "numeric", "b": "categorical", "t": "date", "n": "unknown"}


def test_defaults(spark):
    assert coltypes.default_target(["a", "Target", "target"]) == "target"
    assert coltypes.default_target(["a", "TARGET"]) == "TARGET"
    assert coltypes.default_target(["a", "b"]) == "a"


def test_factorize_follows_first_appearance(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, None), (4, "b"), (5, "c")], "i int, c string")
    codes = {r.i: r.code for r in coltypes.factorize(df, "c", ["i"]).collect()}
    assert codes == {1: 0, 2: -1, 3: 1, 4: 0, 5: 2}


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, " a,\"b\" ", 1.5), (2, "N/A", None), (3, None, 2.0)], "i long, t string, x double")
    path = fresh_path(spark, "csv")
    tables.write_csv(df, path)
    back = tables.read_table_csv(spark, path)
    assert [f.dataType.simpleString() for f in back.schema] == ["bigint", "string", "double"]
    assert [tuple(r) for r in back.orderBy("i").collect()] == [(1, " a,\"b\" ", 1.5), (2, None, None), (3, None, 2.0)]


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, None, float("nan")), (2, None, None)], "i int, t string, x double")
    assert one(quality.duplicate_count(df))["duplicate_rows"] == 1
    assert one(quality.missing_totals(df)) == {"numeric_missing": 2, "string_missing": 2, "all_missing": 4}
    assert [(r["column"], r.missing, r.missing_pct) for r in quality.missing_report(df).collect()] == [("t", 2, 50.0), ("x", 2, 50.0)]
    assert one(quality.table_summary(df))["bytes"] == 4 * 12 + 2


def test_issue_examples_are_bounded(spark):
    texts = [str(i) for i in range(200)] + [f"{i} kg" for i in range(15)] + ["0 kg"] * 5
    row = one(quality.non_numeric_report(column(spark, texts)))
    assert row["issues"] == 20 and len(row["examples"]) == 10 and row["examples"] == sorted(row["examples"])
    methods = one(quality.suggest_cleaning(column(spark, texts)))["methods"]
    assert methods == quality.NUMERIC_FIXES


def test_text_issues(spark):
    found = lambda texts: {r.issue: r.status for r in quality.text_issue_report(column(spark, texts), "c").collect()}
    assert set(found(["a", "A ", "b  c!", "d"]).values()) == {"found"}
    assert set(found(["a", "b"]).values()) == {"absent"}
    assert set(found([f"w{i}" for i in range(51)]).values()) == {"skipped"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=30))
def test_imputation_keeps_values(spark, cells):
    df = spark.createDataFrame([(i, None if c is None else float(c), None if c is None else str(c)) for i, c in enumerate(cells)], "i int, x double, t string")
    known = {i: c for i, c in enumerate(cells) if c is not None}
    numbers = impute.impute_median(impute.impute_mean(df.withColumn("m", F.col("x")), ["x"]), ["m"])
    for r in impute.impute_mode(numbers).collect():
        if r.i in known:
            assert (r.x, r.m, r.t) == (known[r.i], known[r.i], str(known[r.i]))
        elif known:
            assert r.x is not None and r.m is not None and r.t in {str(v) for v in known.values()}
        else:
            assert r.x is None and r.m is None and r.t == "Unknown"


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "t string")
    assert impute.impute_mode(df).where("t = 'a'").count() == 3


@pytest.mark.parametrize("by", [None, ["g"]])
def test_fill_across_buckets(spark, monkeypatch, by):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 20)
    rows = [(i // 7, i, i % 3, float(i) if i % 40 == 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "t int, i int, g int, x double").repartition(7)
    local = df.toPandas().sort_values("i")
    source = local.groupby("g").x if by else local.x
    for fill, wanted in ((impute.fill_forward, source.ffill()), (impute.fill_backward, source.bfill())):
        got = fill(df, ["x"], ["t", "i"], by).toPandas().sort_values("i").x
        assert got.fillna(-1).tolist() == wanted.fillna(-1).tolist()


def test_proportional_fill(spark):
    df = spark.range(6000).selectExpr("id", "case when id % 2 = 0 then null when id % 6 = 1 then concat('rare', id) else 'hot' end as c")
    filled = impute.impute_proportional(df, "c", "id")
    assert filled.count() == 6000 and filled.where("c is null").count() == 0
    share = filled.join(df.where("c is null").select("id"), "id").where("c = 'hot'").count() / 3000
    assert abs(share - 2 / 3) < 0.04
    same = impute.impute_proportional(df.repartition(9), "c", "id")
    assert same.exceptAll(filled).count() == 0
    empty = df.withColumn("c", F.lit(None).cast("string"))
    assert impute.impute_proportional(empty, "c", "id").where("c is null").count() == 6000


def test_duplicates_by_digest(spark):
    """Only digests are compared: nulls have places, empty texts are no nulls, and zero has one sign."""
    rows = [(None, 1.0, "a"), (None, 1.0, "a"), (1, None, "a"), (None, None, ""), (None, None, None), (None, None, None), (3, 0.0, "b"), (3, -0.0, "b"), (4, float("nan"), "c"), (4, float("nan"), "c")]
    df = spark.createDataFrame(rows, "x int, y double, z string")
    assert one(quality.duplicate_count(df))["duplicate_rows"] == 4
    assert "_h0" in quality.duplicate_count(df)._jdf.queryExecution().toString()
