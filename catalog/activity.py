"""M: activity counts over the events."""

from pyspark.sql import functions as F

from tabwright.operators.activity import (
    feature_usage, login_totals, logins_last_7_days, logins_today, recent_logins, renewal_totals, retention_filter, unique_users,
)
from tabwright.session import fresh_path
from tabwright.streaming.activity import activity_stream, daily_counts

from . import query
from .describing import rounded
from .views import table, view

NOW = "2024-01-20 12:00:00"
LATER = "2024-04-10 00:00:00"


@query(
    "M1_login_totals",
    "SELECT event_type AS type, count(*)::BIGINT AS logins FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events",
)
def _m1(spark, sf):
    return login_totals(view(spark, sf, "activity"), "type")


@query(
    "M2_logins_today",
    f"SELECT count(*)::BIGINT AS logins_today FROM events WHERE ts::DATE = DATE '{NOW[:10]}'",
)
def _m2(spark, sf):
    return logins_today(view(spark, sf, "activity"), "ts", NOW)


@query(
    "M3_logins_last_7_days",
    f"SELECT count(*)::BIGINT AS logins_last_7_days FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS",
)
def _m3(spark, sf):
    return logins_last_7_days(view(spark, sf, "activity"), "ts", NOW)


@query("M4_unique_users", "SELECT count(DISTINCT user_id)::BIGINT AS unique_users FROM events")
def _m4(spark, sf):
    return unique_users(view(spark, sf, "activity"), "user_id")


@query(
    "M5_recent_logins",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type AS type FROM events ORDER BY events.ts DESC, event_id LIMIT 20",
)
def _m5(spark, sf):
    return recent_logins(view(spark, sf, "activity").drop("value"), "ts", "event_id")


@query("M6_feature_usage", "SELECT event_type AS feature, count(*)::BIGINT AS uses FROM events GROUP BY 1")
def _m6(spark, sf):
    return feature_usage(view(spark, sf, "activity"), "type")


@query(
    "M7_renewal_totals",
    "SELECT count(*)::BIGINT + 3 AS renewals, round(coalesce(sum(value), 0) + 150, 4) AS revenue FROM events WHERE event_type = 'purchase'",
)
def _m7(spark, sf):
    renewals = view(spark, sf, "activity").where("type = 'purchase'")
    return rounded(renewal_totals(renewals, "value", 3, 150.0), 4, "revenue")


@query(
    "M8_retention_filter",
    f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{LATER}' - INTERVAL 90 DAYS",
)
def _m8(spark, sf):
    return retention_filter(view(spark, sf, "activity"), "ts", LATER).select("event_id")


DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"


def _texted(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("M9_daily_counts", DAILY)
def _m9_batch(spark, sf):
    events = view(spark, sf, "activity").withColumn("ts", F.col("ts").cast("timestamp"))
    return _texted(daily_counts(events, "ts", "type"))


@query(
    "M9_activity_stream",
    # A day is final once a later event has moved the watermark past its end.
    DAILY + " HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def _m9(spark, sf):
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    out = fresh_path(spark, "activity")
    activity_stream(stream, "ts", "type", out, fresh_path(spark, "stream-state")).awaitTermination()
    return _texted(spark.read.schema("day date, type string, n bigint").parquet(out))
