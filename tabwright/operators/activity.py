"""Counts over a log of user events: (ts, user, type)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.scalars import col

KEEP_DAYS = 90


def _at(df: DataFrame, ts: str, now: datetime | str) -> Column:
    kind = "timestamp_ntz" if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else "timestamp"
    return F.lit(str(now)).cast(kind)


def login_totals(events: DataFrame, kind: str) -> DataFrame:
    """(type, logins) and the total under the type ``all``."""
    totals = events.groupBy(col(kind).alias("type")).agg(F.count(F.lit(1)).alias("logins"))
    # The total adds up the few per-type rows.
    return totals.unionByName(totals.agg(F.lit("all").alias("type"), F.coalesce(F.sum("logins"), F.lit(0)).alias("logins")))


def logins_today(events: DataFrame, ts: str, now: datetime | str) -> DataFrame:
    """One row: events on the calendar date of ``now``; the filter is a range, so it reaches the scan."""
    day = F.date_trunc("day", _at(events, ts, now)).cast(events.schema[ts].dataType)
    window = (col(ts) >= day) & (col(ts) < day + F.expr("INTERVAL 1 DAY"))
    return events.where(window).agg(F.count(F.lit(1)).alias("logins_today"))


def logins_last_7_days(events: DataFrame, ts: str, now: datetime | str) -> DataFrame:
    """One row: events less than seven days old."""
    return events.where(col(ts) > _at(events, ts, now) - F.expr("INTERVAL 7 DAYS")).agg(
        F.count(F.lit(1)).alias("logins_last_7_days")
    )


def unique_users(events: DataFrame, user: str, approximate: bool = False) -> DataFrame:
    """One row: distinct users, exact or from a sketch."""
    count = F.approx_count_distinct(col(user), 0.01) if approximate else F.count_distinct(col(user))
    return events.agg(count.alias("unique_users"))


def recent_logins(events: DataFrame, ts: str, tie: str, n: int = 20) -> DataFrame:
    """The newest n events with the timestamp as text."""
    newest = events.orderBy(col(ts).desc(), col(tie).asc()).limit(n)
    return newest.withColumn(ts, F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss"))


def feature_usage(events: DataFrame, feature: str) -> DataFrame:
    """(feature, uses), most used first."""
    return (
        events.groupBy(col(feature).alias("feature"))
        .agg(F.count(F.lit(1)).alias("uses"))
        .orderBy(F.desc("uses"), "feature")
    )


def renewal_totals(renewals: DataFrame, amount: str, opening_count: int = 0, opening_revenue: float = 0.0) -> DataFrame:
    """One row: renewals and revenue on top of the opening values."""
    return renewals.agg(
        (F.count(F.lit(1)) + opening_count).alias("renewals"),
        (F.coalesce(F.sum(col(amount)), F.lit(0.0)) + opening_revenue).alias("revenue"),
    )


def retention_filter(log: DataFrame, ts: str, now: datetime | str, days: int = KEEP_DAYS) -> DataFrame:
    """Rows of the last ``days`` days; the filter reaches the scan."""
    return log.where(col(ts) >= _at(log, ts, now) - F.expr(f"INTERVAL {int(days)} DAYS"))
