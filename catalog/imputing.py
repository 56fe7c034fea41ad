"""F: imputation over the dirty orders."""

from pyspark.sql import functions as F

from tabwright.operators.coltypes import factorize
from tabwright.operators.impute import (
    fill_backward, fill_forward, impute_features_mean, impute_mean, impute_median, impute_mode, impute_proportional, proportion_table,
)

from . import query
from .views import cte, hash_sql, table, view

DIRTY = cte("dirty_orders")


@query(
    "F1_impute_mean",
    DIRTY + "SELECT o_orderkey, round(coalesce(price_num, (SELECT avg(price_num) FROM dirty_orders)), 4) AS price_num FROM dirty_orders",
)
def _f1(spark, sf):
    filled = impute_mean(view(spark, sf, "dirty_orders"), ["price_num"])
    return filled.select("o_orderkey", F.round("price_num", 4).alias("price_num"))


@query(
    "F2_impute_median",
    DIRTY + "SELECT o_orderkey, round(coalesce(price_num, (SELECT median(price_num) FROM dirty_orders)), 4) AS price_num FROM dirty_orders",
)
def _f2(spark, sf):
    filled = impute_median(view(spark, sf, "dirty_orders"), ["price_num"])
    return filled.select("o_orderkey", F.round("price_num", 4).alias("price_num"))


@query(
    "F2_impute_median_approximate",
    DIRTY + "SELECT o_orderkey, price_num IS NULL AS filled, coalesce(price_num, 0) AS known, true AS near_middle FROM dirty_orders",
)
def _f2_approximate(spark, sf):
    """Every gap gets a value whose rank lies within one hundredth of the middle; known values stay."""
    rows = view(spark, sf, "dirty_orders").select("o_orderkey", "price_num")
    filled = impute_median(rows, ["price_num"], approximate=True).select("o_orderkey", F.col("price_num").alias("value"))
    low, high = (rows.select(F.percentile("price_num", F.lit(p))).scalar() for p in (0.49, 0.51))
    gap = F.col("price_num").isNull()
    middle = F.coalesce(F.col("value").between(low, high), F.lit(False))
    return rows.join(filled, "o_orderkey").select(
        "o_orderkey", gap.alias("filled"), F.coalesce("price_num", F.lit(0.0)).alias("known"),
        F.when(gap, middle).otherwise(F.col("value") == F.col("price_num")).alias("near_middle"),
    )


def _fill_sql(function: str, frame: str, extra: str = "") -> str:
    window = f"OVER ({extra}ORDER BY o_orderkey ROWS BETWEEN {frame})"
    columns = ", ".join(f"{function}({c} IGNORE NULLS) {window} AS {c}" for c in ("price_txt", "price_num", "prio_txt"))
    return DIRTY + f"SELECT o_orderkey, {columns} FROM dirty_orders"


@query("F3_fill_forward", _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def _f3(spark, sf):
    return fill_forward(view(spark, sf, "dirty_orders"), None, ["o_orderkey"])


@query(
    "F3_fill_forward_by_user",
    """SELECT event_id, user_id, last_value(CASE WHEN value > 5 THEN value END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events""",
)
def _f3_by_user(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return fill_forward(events, ["value"], ["ts", "event_id"], ["user_id"]).drop("ts")


@query(
    "F3_fill_forward_text_key",
    """SELECT name, last_value(price IGNORE NULLS) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
    FROM (SELECT concat('order ', md5(cast(o_orderkey AS varchar)), ' é') AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders)""",
)
def _f3_text(spark, sf):
    orders = table(spark, sf, "orders")
    name = F.concat(F.lit("order "), F.md5(F.col("o_orderkey").cast("string")), F.lit(" é"))
    rows = orders.select(name.alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"))
    return fill_forward(rows, ["price"], ["name"])


@query(
    "B6_factorize_text_key",
    """SELECT name, seg, dense_rank() OVER (ORDER BY first) - 1 AS code FROM (SELECT c_name AS name, c_mktsegment AS seg,
    min(c_name) OVER (PARTITION BY c_mktsegment) AS first FROM customer)""",
)
def _b6_text(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return factorize(rows, "seg", ["name"])


@query("F4_fill_backward", _fill_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def _f4(spark, sf):
    return fill_backward(view(spark, sf, "dirty_orders"), None, ["o_orderkey"])


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "F5_impute_mode",
    DIRTY + f"""SELECT o_orderkey, coalesce(price_txt, {_mode_sql('price_txt')}) AS price_txt,
    coalesce(prio_txt, {_mode_sql('prio_txt')}) AS prio_txt FROM dirty_orders""",
)
def _f5(spark, sf):
    return impute_mode(view(spark, sf, "dirty_orders")).select("o_orderkey", "price_txt", "prio_txt")


@query(
    "F6_impute_proportional",
    DIRTY
    + f""", c AS (SELECT prio_txt AS category, count(*) AS cnt FROM dirty_orders WHERE prio_txt IS NOT NULL GROUP BY prio_txt),
    s AS (SELECT category, sum(cnt) OVER (ORDER BY md5(category), category) AS high, cnt FROM c),
    m AS (SELECT o_orderkey, floor({hash_sql('o_orderkey')} / 4503599627370496.0::DOUBLE * (SELECT sum(cnt) FROM c)) AS draw
      FROM dirty_orders WHERE prio_txt IS NULL)
    SELECT o_orderkey, prio_txt FROM dirty_orders WHERE prio_txt IS NOT NULL
    UNION ALL SELECT o_orderkey, category FROM m JOIN s ON draw >= high - cnt AND draw < high""",
)
def _f6(spark, sf):
    return impute_proportional(view(spark, sf, "dirty_orders").select("o_orderkey", "prio_txt"), "prio_txt", "o_orderkey")


@query(
    "F7_proportion_table",
    DIRTY + """SELECT prio_txt AS category, count(*)::BIGINT AS cnt, round(count(*) / (SELECT count(prio_txt) FROM dirty_orders), 6) AS share
    FROM dirty_orders WHERE prio_txt IS NOT NULL GROUP BY prio_txt""",
)
def _f7(spark, sf):
    return proportion_table(view(spark, sf, "dirty_orders"), "prio_txt").withColumn("share", F.round("share", 6))


@query(
    "F8_impute_features_mean",
    cte("outlier_orders")
    + """SELECT o_orderkey, x, round(coalesce(c, (SELECT avg(c) FROM outlier_orders WHERE x < 300000)), 4) AS c FROM outlier_orders""",
)
def _f8(spark, sf):
    rows = view(spark, sf, "outlier_orders").drop("k")
    return impute_features_mean(rows, ["c"], fit_on=rows.where("x < 300000")).withColumn("c", F.round("c", 4))
