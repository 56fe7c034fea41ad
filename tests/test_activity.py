"""Activity counts, the stream against the batch, and the query catalog."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import catalog
from tabwright.operators import activity
from tabwright.session import fresh_path
from tabwright.streaming.activity import activity_stream, daily_counts

from .conftest import one

NOW = "2024-01-10 12:00:00"
ROWS = [
    (1, "2024-01-10 00:00:00", "a", "Student"), (2, "2024-01-09 23:59:59", "b", "Admin"), (3, "2024-01-03 12:00:00", "a", "Student"),
    (4, "2024-01-03 12:00:01", "c", "Student"), (5, "2023-10-12 12:00:00", "c", "Student"), (6, "2023-10-12 11:59:59", "c", "Admin"),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, "id int, ts string, user string, type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_counts(log):
    assert {r.type: r.logins for r in activity.login_totals(log, "type").collect()} == {"Student": 4, "Admin": 2, "all": 6}
    assert one(activity.logins_today(log, "ts", NOW))["logins_today"] == 1
    assert one(activity.logins_last_7_days(log, "ts", NOW))["logins_last_7_days"] == 3
    assert one(activity.unique_users(log, "user"))["unique_users"] == 3
    assert {r.id for r in activity.retention_filter(log, "ts", NOW).collect()} == {1, 2, 3, 4, 5}
    assert [(r.id, r.ts) for r in activity.recent_logins(log, "ts", "id", 2).collect()] == [(1, "2024-01-10 00:00:00"), (2, "2024-01-09 23:59:59")]
    assert one(activity.renewal_totals(log.where("id < 0"), "id", 3, 150.0)) == {"renewals": 3, "revenue": 150.0}


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for df in (activity.logins_today(events, "ts", NOW), activity.retention_filter(events, "ts", NOW)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan.split("PushedFilters")[1]


def test_stream_drops_late_events(spark):
    source, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    state = fresh_path(spark, "state")
    schema = "ts timestamp, type string"

    def deliver(*rows):
        spark.createDataFrame(list(rows), "ts string, type string").selectExpr("cast(ts as timestamp) ts", "type").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        activity_stream(stream, "ts", "type", out, state).awaitTermination()

    deliver(("2024-01-01 10:00:00", "a"), ("2024-01-02 08:00:00", "a"))
    deliver(("2024-01-01 23:00:00", "a"), ("2024-01-04 00:00:00", "b"))
    deliver(("2024-01-06 00:00:00", "b"))
    rows = {(str(r.day), r.type): r.n for r in spark.read.parquet(out).collect()}
    assert rows == {("2024-01-01", "a"): 1, ("2024-01-02", "a"): 1, ("2024-01-04", "b"): 1}


def test_batch_counts(spark, log):
    rows = daily_counts(log.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "type").collect()
    assert sum(r.n for r in rows) == 6


def test_catalog_contract(spark):
    names, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(names)
    # Corpus operators may be registered beside the catalog.
    assert set(catalog.QUERIES) <= set(names) and set(catalog.QUERIES) == set(catalog.ORACLE)
    families = {n.split("_")[0] for n in catalog.QUERIES}
    wanted = [("A", 5), ("B", 9), ("C", 7), ("D", 10), ("E", 9), ("F", 8), ("G", 13), ("H", 10), ("I", 5), ("J", 2), ("K", 15), ("L", 27), ("M", 9)]
    assert families == {f"{letter}{i}" for letter, n in wanted for i in range(1, n + 1)}
    assert entry.entry(spark).count() == 1


FAST = ["B9_dtype_report", "C1_extract_numbers", "E3_missing_report", "G5_frequency_table", "K2_train_test_split", "M9_daily_counts"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    df = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(cursor.fetchall(), key=key)
